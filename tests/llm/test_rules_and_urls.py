"""Adaptive thresholds and url features against plain Python; edge cases."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm_operators import SF, same

from ampliq.llm import quality_rules, urls

def prose(rng, n, odd):
    """``n`` words, about ``odd`` percent of which end in a comma."""
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) + ("," if rng.randrange(100) < odd else "") for _ in range(n))


def group(rng, source, odd, n=300):
    return [(None, prose(rng, rng.randint(60, 120), odd), "en", source) for _ in range(n)]


def verdicts(spark, rows):
    df = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    return {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}, df


def test_a_groups_rates_move_its_threshold_and_verdicts(spark):
    rng = random.Random(1)
    probe = prose(rng, 100, 0).replace(" ", " ## ", 38)
    others, low, high = group(rng, "c", 8, 600), group(rng, "a", 5), group(rng, "b", 30)
    got, df = verdicts(spark, [(None, probe, "en", "a"), (None, probe, "en", "b"), *low, *high, *others])
    assert got[0]["odd_rate"] == got[1]["odd_rate"]
    assert got[0]["odd_rate_max"] < got[1]["odd_rate_max"]
    assert (got[0]["kept"], got[1]["kept"]) == (False, True)
    assert sum(r["kept"] for r in got.values()) > 0.99 * len(got) - 2
    moved, _ = verdicts(spark, [(None, probe, "en", "a"), (None, probe, "en", "b"), *group(rng, "a", 30), *high, *others])
    assert moved[0]["odd_rate_max"] > got[0]["odd_rate_max"] and moved[0]["kept"]
    same(quality_rules.quality_rules(df), quality_rules.ORACLE, "documents", documents=df.toArrow())


def test_junk_cannot_lift_the_threshold_of_its_source(spark):
    rng = random.Random(2)
    junk = [(None, prose(rng, 80, 0).replace(" ", " #$% "), "en", s) for s in ["c"] * 200 + ["alone"]]
    got, df = verdicts(spark, junk + group(rng, "a", 5, 500) + group(rng, "c", 5, 100))
    assert not any(got[i]["kept"] for i in range(len(junk)))
    assert sum(got[i]["kept"] for i in range(len(junk), len(got))) > 0.98 * 600
    same(quality_rules.quality_rules(df), quality_rules.ORACLE, "documents", documents=df.toArrow())


def test_words_as_long_as_sentences_have_a_threshold_of_their_own(spark):
    """Rates far beyond the digits that cells keep: clean documents stay, longer words than theirs go."""
    rng = random.Random(4)
    sentences = lambda n: " ".join("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(rng.randint(n // 2, n))) for _ in range(30))
    rows = [(None, sentences(600), "zh", "z") for _ in range(300)] + [(None, sentences(9000), "zh", "z") for _ in range(5)] + group(rng, "a", 5, 200)
    got, df = verdicts(spark, rows)
    assert min(got[i]["word_length"] for i in range(305)) > 30_000 and got[0]["word_length_max"] > got[400]["word_length_max"]
    assert sum(got[i]["kept"] for i in range(300)) > 290 and not any(got[i]["kept"] for i in range(300, 305))
    same(quality_rules.quality_rules(df), quality_rules.ORACLE, "documents", documents=df.toArrow())


def features(url):
    u = url or ""
    host = path = ""
    if "://" in u:
        rest = u.split("://", 1)[1]
        k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:k])
        k2 = next((i for i in range(k, len(rest)) if rest[i] in "?#"), len(rest))
        path = rest[k:k2]
    both = (host + path).lower()
    entropy = -sum(c / len(both) * math.log2(c / len(both)) for c in Counter(both).values()) if both else 0.0
    marks = [i for i, c in enumerate(u[:-1]) if c in "?&" and u[i + 1] not in "&#"]
    count, last = 0, -2
    for i in marks:  # matches don't overlap
        if i > last + 1:
            count, last = count + 1, i
    own = (len(u), sum(a == "/" != b for a, b in zip(path, path[1:], strict=False)), sum(c in "0123456789" for c in u) / max(1, len(u)), entropy, count if "?" in u else 0, len(host.split(".")), host.count("-"))
    return host, path, own, (host.rsplit(".", 1)[-1], ".".join(host.rsplit(".", 2)[-2:]))


ODD = [None, "", "no scheme", "://", "http://", "http://A.b-c.COM", "http://a?x=1&&y=2&", "https://x.y/1//2/#?a=b", "http://é.org/ü?ö=1", "http://x.com/" + "a" * 3000, "http://x.com/" + "9" * 50]


def test_features_are_those_of_plain_python(spark):
    rows = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()] + [(-i, u) for i, u in enumerate(ODD)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    for r in urls.lexical(urls.split_url(df)).collect():
        host, path, own, suffix = features(r["url"])
        assert (r["host"], r["path"], (r["suffix"], r["suffix2"])) == (host, path, suffix), r["url"]
        assert [r[f] for f in urls.FEATURES[:-2]] == pytest.approx(own, abs=6e-5), r["url"]


def test_suffix_shares_are_out_of_fold(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(6), rng.randrange(urls.FOLDS), float(rng.randrange(2))) for _ in range(400)]
    every = sum(y for _, _, y in rows) / len(rows)
    want = {(-1, -1): round(every, 4)}
    by = defaultdict(list)
    for b, f, y in rows:
        by[b].append((f, y))
    for b, seen in by.items():
        for f in {-1} | {f for f, _ in seen}:
            own = [y for g, y in seen if g != f]
            want[b, f] = (sum(own) + urls.PRIOR * every) / (len(own) + urls.PRIOR)
    got = urls.suffix_shares(spark.createDataFrame(rows, "bucket int, fold int, label double")).collect()
    assert {(r["bucket"], r["fold"]): r["share"] for r in got} == pytest.approx(want, abs=6e-5)


def test_scores_agree_with_the_trees(spark):
    """The score is the logistic of twice the weighted trees, whose inputs hold no label of their own row."""
    rng = random.Random(7)
    rows = []
    for _ in range(600):
        f = [rng.randrange(9) for _ in urls.FEATURES]
        rows.append((*f, float(f[0] > 4 or f[3] > 6)))
    df = spark.createDataFrame(rows, ", ".join(f"{f} int" for f in urls.FEATURES) + ", label double")
    model = urls.train(df)
    out = model.transform(urls._vectors().transform(df)).select("features", "probability", "label").collect()
    for r in out[:50]:
        margin = sum(w * t.predict(r["features"]) for w, t in zip(model.treeWeights, model.trees, strict=True))
        assert r["probability"][1] == pytest.approx(1 / (1 + math.exp(-2 * margin)))
    assert sum((r["probability"][1] >= 0.5) == r["label"] for r in out) > 0.97 * len(out)
    assert urls.train(df.where("label = 1")) == 1.0 and urls.train(df.where("label = 7")) == 0.0


def test_url_filter_odd_rows_and_reruns(spark):
    rows = [(i, u, "clash", "clash", 1.0) for i, u in enumerate(ODD + ODD)]
    df = spark.createDataFrame(rows, "page_id long, url string, suffix string, bucket string, score double")
    labelled = spark.createDataFrame([("http://a.b/1", 1), ("http://c.d/x", 0), (None, 0), ("x", None)], "url string, blocked int")
    for known in (None, labelled, labelled.where("blocked = 1")):
        one, two = urls.url_filter(df, known).collect(), urls.url_filter(df.repartition(3), known).collect()
        assert Counter(map(tuple, one)) == Counter(map(tuple, two)) and len(one) == len(rows)
        assert {r["verdict"] for r in one} <= {"allow", "block"}


def test_trees_tell_held_out_urls_apart(spark):
    """Labels that follow from length, digits and suffix together: the trees, taught by some hosts, rank the urls of others."""
    rng = random.Random(9)

    def row(k):
        bad = rng.random() < 0.4
        host = f"h{k % 80}{'-promo' * (bad and rng.random() < 0.5)}.{rng.choice(['site', 'web'])}.{rng.choice(['net', 'info'] if bad else ['net', 'org'])}"
        path = "/".join(rng.choice(["news", "item", "page"]) for _ in range(rng.randrange(1, 4)))
        query = "?" + "&".join(f"p{i}={rng.randrange(10**9)}" for i in range(rng.randrange(1, 5))) if bad or rng.random() < 0.2 else ""
        return k, f"http://{host}/{path}{query}", int(bad)

    rows = [row(k) for k in range(1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, blocked int")
    taught, rest = df.where("page_id % 80 < 50"), df.where("page_id % 80 >= 50")
    scores = {r.page_id: r.score for r in urls.url_filter(rest, taught, rules=()).collect()}
    good, bad = ([scores[k] for k, _, y in rows if k in scores and y == label] for label in (0, 1))
    auc = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    assert auc > 0.95
    seen = urls.lexical(urls.split_url(df)).agg(*(F.count_distinct(f).alias(f) for f in urls.FEATURES[:-2])).first()
    assert seen.f_length > 30 and seen.f_digits > 50 and seen.f_entropy > 200
