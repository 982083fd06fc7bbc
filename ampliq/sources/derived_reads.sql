WITH k AS (
 SELECT event_id AS read_id, user_id % 12 AS patient,
  CASE WHEN event_id % 2 = 0 THEN 'POOLA' ELSE 'POOLB' END AS pool,
  CASE WHEN event_id % 4 >= 2 THEN 'rv' ELSE 'fw' END AS true_strand,
  CASE WHEN (event_id * 7919) % 101 < 50 THEN 0 WHEN (event_id * 7919) % 101 < 70 THEN 1
       WHEN (event_id * 7919) % 101 < 80 THEN 2 ELSE 3 + (event_id * 7919) % 101 - 80 END AS hap,
  concat(CASE WHEN event_id % 2 = 0 THEN 'POOLA' ELSE 'POOLB' END, '.', cast(user_id % 12 AS string)) AS skey,
  concat(CASE WHEN event_id % 2 = 0 THEN 'POOLA' ELSE 'POOLB' END, '.', cast(user_id % 12 % 9 AS string)) AS mkey
 FROM events),
d AS (
 SELECT *,
  substring(translate(md5(concat('mid',skey)),'0123456789abcdef','ACGTACGTACGTACGT'),1,10) AS mid_seq,
  substring(translate(md5(concat('fwp',pool)),'0123456789abcdef','ACGTACGTACGTACGT'),1,20) AS fw_primer,
  substring(translate(md5(concat('rvp',pool)),'0123456789abcdef','ACGTACGTACGTACGT'),1,20) AS rv_primer,
  translate(concat(md5(concat(mkey,'#1')),md5(concat(mkey,'#2')),md5(concat(mkey,'#3')),md5(concat(mkey,'#4')),
   md5(concat(mkey,'#5')),md5(concat(mkey,'#6')),md5(concat(mkey,'#7'))),'0123456789abcdef','ACGTACGTACGTACGT') AS master_seq
 FROM k),
a AS (
 SELECT *,
  CASE WHEN hap = 0 THEN master_seq
       WHEN hap % 7 = 2 THEN concat(substring(master_seq,1,(hap*5)%200),'---',substring(master_seq,(hap*5)%200+4,224))
       ELSE concat(substring(master_seq,1,(hap*5)%200),translate(substring(master_seq,(hap*5)%200+1,1),'ACGT','CATG'),
            substring(master_seq,(hap*5)%200+2,224)) END AS amplicon_aln,
  CASE WHEN read_id % 11 = 3 THEN concat(translate(substring(mid_seq,1,1),'ACGT','CATG'),substring(mid_seq,2,9))
       WHEN read_id % 13 = 7 THEN concat(translate(substring(mid_seq,1,4),'ACGT','CATG'),substring(mid_seq,5,6))
       ELSE mid_seq END AS mid_obs,
  CASE WHEN read_id % 23 = 2 THEN concat('NNNN',substring(fw_primer,5,16))
       WHEN read_id % 29 = 4 THEN concat(translate(substring(fw_primer,1,3),'ACGT','CATG'),substring(fw_primer,4,17))
       ELSE fw_primer END AS fw_obs,
  CASE WHEN read_id % 19 = 5 THEN translate(rv_primer,'ACGT','CATG') ELSE rv_primer END AS rv_obs
 FROM d),
f AS (
 SELECT *, concat('ACGTT',mid_obs,fw_obs,replace(amplicon_aln,'-',''),reverse(translate(rv_obs,'ACGTN','TGCAN')),
                  reverse(translate(mid_obs,'ACGT','TGCA')),'AACGT') AS fw_seq FROM a),
s AS (
 SELECT *, CASE WHEN read_id % 17 = 9 THEN substring(fw_seq,1,140)
   WHEN true_strand = 'rv' THEN reverse(translate(fw_seq,'ACGTN','TGCAN')) ELSE fw_seq END AS seq FROM f)
SELECT read_id, pool, patient, true_strand, hap, mid_seq, fw_primer, rv_primer, master_seq, amplicon_aln, seq,
 substring(translate(repeat(concat(md5(concat('q1',cast(read_id AS string))),md5(concat('q2',cast(read_id AS string)))),5),
  '0123456789abcdef', CASE WHEN read_id % 3 = 0 THEN '#>?@ABCDEFGHIJJJ' ELSE '?@@AABCDEFGHIJJJ' END),1,length(seq)) AS qual
FROM s
