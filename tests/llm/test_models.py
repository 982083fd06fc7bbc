"""Classifier, mix and language model against plain versions of the same formulas."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from test_llm_operators import SF, WORDS, odd_rows

from ampliq.llm import langid, mixing, quality_model

BIG = SF.replace("0.001", "0.01")


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def pooled(x, good, seen):
    """Isotonic fit by its min-max formula."""
    fit = []
    for i in range(len(x)):
        fit.append(max(min(sum(good[a : b + 1]) / sum(seen[a : b + 1]) for b in range(i, len(x))) for a in range(i + 1)))
    return np.array(fit)


def test_scores_are_those_of_lstsq_and_pooling(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    rows = quality_model.document_statistics(docs.select("doc_id", "text")).collect()
    quality = {r["doc_id"]: float(r["quality"]) for r in labels.collect() if r["quality"] is not None}
    x = np.array([[r[s] for s in quality_model.STATS] for r in rows])
    part = np.array([fold(r["doc_id"]) for r in rows])
    y = np.array([quality.get(r["doc_id"], np.nan) for r in rows])
    fit, calibrate = ~np.isnan(y) & (part != 2) & (part != 3), ~np.isnan(y) & (part == 3)
    mean = x[fit].mean(0)
    spread = np.sqrt(np.maximum((x[fit] ** 2).mean(0) - mean**2, 1e-6))
    draw = np.random.Generator(np.random.PCG64(6))
    w, b = draw.normal(0, np.sqrt(2 * quality_model.GAMMA), (x.shape[1], quality_model.N_FEATURES)), draw.uniform(0, 2 * np.pi, quality_model.N_FEATURES)
    unit = 1 << quality_model.BITS
    z = np.concatenate((np.ones((len(x), 1)), np.rint(np.cos(np.clip((x - mean) / spread, -6, 6) @ w + b) * unit) / unit), 1)
    penalty = np.sqrt(quality_model.RIDGE * fit.sum()) * np.eye(z.shape[1])
    penalty[0, 0] = np.sqrt(1e-9)
    weights = np.linalg.lstsq(np.concatenate((z[fit], penalty)), np.concatenate((y[fit], np.zeros(len(penalty)))), rcond=None)[0]
    raw = z @ weights
    cells = np.floor(np.clip(raw[calibrate], -0.5, 1.5) * (quality_model.SCORE_BINS / 2))
    at = sorted(set(cells.tolist()))
    good, seen = [y[calibrate][cells == c].sum() for c in at], [(cells == c).sum() for c in at]
    fitted = pooled(at, good, seen)
    level = sorted(set(np.round(fitted, 12).tolist()))
    knots, values = [], []
    for v in level:
        own = [k for k in range(len(at)) if abs(fitted[k] - v) < 1e-9]
        knots.append(sum((at[k] + 0.5) * 2 / quality_model.SCORE_BINS * seen[k] for k in own) / sum(seen[k] for k in own))
        values.append(v)
    want = Counter((r["doc_id"], round(float(s), 4)) for r, s in zip(rows, np.interp(raw, knots, values), strict=True))
    got = quality_model.classify(docs, labels).collect()
    assert Counter((r["doc_id"], round(r["score"], 4)) for r in got) == want
    assert all(r["held_out"] == (fold(r["doc_id"]) == 2) and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_labels_of_the_held_out_fold_have_no_part(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    flipped = spark.createDataFrame([(r["doc_id"], 1 - r["quality"] if fold(r["doc_id"]) == 2 else r["quality"]) for r in labels.collect()], "doc_id long, quality int")
    score = lambda known: {(r["doc_id"], r["score"]) for r in quality_model.classify(docs, known).collect()}
    assert score(labels) == score(flipped)


def test_rates_solve_the_dual(spark):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long, node string, k1 int, size int, score string")):
        rows = mixing.mix_sources(df, keep=("source",)).collect()
        for source in {r["source"] for r in rows}:
            own = [r for r in rows if r["source"] == source and r["size"]]
            if not own:
                continue
            scale = sum(r["size"] for r in own) / len(own)
            low, high = -mixing.FAR, mixing.FAR
            for _ in range(200):
                a = (low + high) / 2
                took = sum(r["size"] * min(3.0, math.exp(min(mixing.FAR, max(-mixing.FAR, a * r["size"] / scale)))) for r in own)
                low, high = (a, high) if took < own[0]["target"] else (low, a)
            if own[0]["target"] < 3 * sum(r["size"] for r in own) - 1e-6:
                for r in own:
                    assert r["rate"] == pytest.approx(min(3.0, math.exp(min(mixing.FAR, max(-mixing.FAR, a * r["size"] / scale)))), rel=1e-4)


def words(text):
    out, now = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def bucket(a, b, c):
    x = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & 0xFFFFFFFF
    return (((x ^ x >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF) >> 17


def trigrams(word):
    codes = [0, *map(ord, word), 0]
    return [bucket(*codes[i : i + 3]) for i in range(len(word))]


def script(c):
    return [name for start, name in langid.SCRIPTS if start <= ord(c)][-1]


def test_languages_are_those_of_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    mixed = [(-k, f"{docs[k]['text'] or ''} Ελλάδα {docs[-k]['text'] or ''} кот 漢字 x", "en") for k in range(1, 4)] + [(-9, None, "en"), (-10, "12 !", None), (-11, "", "de"), (-12, "слово", "ru")]
    df = spark.createDataFrame([tuple(r) for r in docs] + mixed, "doc_id long, text string, lang string")
    grams, scripts = {}, {}
    for r in df.collect():
        if fold(r["doc_id"]) != 2 and r["text"] is not None and r["lang"] is not None:
            for w in words(r["text"]):
                grams.setdefault(r["lang"], Counter()).update(trigrams(w))
                scripts.setdefault(r["lang"], Counter()).update(script(c) for c in w)
    langs = sorted(grams)
    total = {g: sum(grams[g].values()) for g in langs}
    names = {name for _, name in langid.SCRIPTS}
    allowed = {s: {g for g in langs if scripts[g][s] >= langid.SCRIPT_SHARE * max(1, total[g])} or set(langs) for s in names}
    log = {g: lambda t, g=g: math.log((grams[g][t] + 0.5) / (total[g] + 0.5 * langid.BUCKETS)) for g in langs}
    odd = 0
    for r in sorted(langid.language_id(df).collect(), key=lambda r: r["doc_id"]):
        text = next(d["text"] for d in df.where(f"doc_id = {r['doc_id']}").take(1)) if r["doc_id"] < 0 or r["doc_id"] % 10 == 0 else False
        if text is False:
            continue
        every = words(text or "")
        if not every:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        best, back = {g: 0.0 for g in langs}, []
        for k, w in enumerate(every):
            own = {g: sum(log[g](t) for t in trigrams(w)) - (0 if g in allowed[script(w[0])] else 50) for g in langs}
            top = max(langs, key=lambda g: best[g])
            step = {g: g if not k or best[g] >= best[top] - langid.SWITCH else top for g in langs}
            best = {g: (max(best[g], best[top] - langid.SWITCH) if k else 0.0) + own[g] for g in langs}
            back.append(step)
        path = [max(langs, key=lambda g: best[g])]
        for step in back[:0:-1]:
            path.append(step[path[-1]])
        letters = Counter()
        for w, g in zip(every, path[::-1], strict=True):
            letters[g] += len(w)
        share = letters.most_common(1)[0][1] / sum(letters.values())
        odd += abs(r["score"] - share) > 1e-9 or letters[r["lang_pred"]] < max(letters.values())
    assert odd == 0


def test_hundreds_of_languages_are_all_learnt(spark):
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows, k = [], 0
    for lang in range(600):
        own = rng.choice(letters, 8, replace=False)
        vocabulary = ["".join(rng.choice(own, rng.integers(2, 8))) + f"{chr(97 + lang % 26)}{chr(97 + lang // 26)}" for _ in range(30)]
        for _ in range(3):
            rows.append((k := k + 1, " ".join(rng.choice(vocabulary, 60)), f"l{lang:03}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, "text", "lang")
    assert len(model["langs"]) == 600 and "cells" in model
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, model).collect()}
    assert len(set(got.values())) == 600 and sum(got[i] == g for i, _, g in rows) >= 0.99 * len(rows)
    dense = np.tile(model["base"], (langid.BUCKETS, 1))
    starts, lang_of, more = model["cells"]
    np.add.at(dense, (np.repeat(np.arange(langid.BUCKETS), np.diff(starts)), lang_of), more)
    other = {c: model[c] for c in ("langs", "base", "allowed")} | {"logs": dense.astype(np.float32)}
    for _, text, _ in rows[:20]:
        a, b = langid.word_scores(text + " слово 12 x", model), langid.word_scores(text + " слово 12 x", other)
        assert np.allclose(a[0], b[0], atol=1e-2) and (a[1] == b[1]).all()


def test_long_texts_are_labelled_in_slices(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and lang is not null")
    model = langid.train(docs, "text", "lang")
    text = " ".join(r["text"] for r in docs.orderBy("doc_id").limit(60).collect()) + " " + "ж" * 5000 + " end"
    whole = langid.word_scores(text, model)
    path = langid.viterbi([whole[0]])[0]
    for size in (1000, 30000):
        monkeypatch.setattr(langid, "_slice_size", lambda _, size=size: size)
        scores, letters = langid.word_scores(text, model)
        if size > 5000:
            assert np.allclose(scores, whole[0]) and (letters == whole[1]).all()
            parts = list(langid.long_path(text, model))[::-1]
            assert (np.concatenate([p for p, _ in parts]) == path).all() and (np.concatenate([n for _, n in parts]) == letters).all()
            for spans in (True, False):
                one, many = langid._summary([(path, letters)], model["langs"], spans), langid._summary(parts, model["langs"], spans)
                assert one == many and one[2] == 1 + int((path[1:] != path[:-1]).sum())
    monkeypatch.undo()


def test_a_very_long_text_takes_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    langs = [f"l{k}" for k in range(300)]
    model = {"langs": langs, "base": np.full(300, -12.0), "allowed": np.ones((langid.N_SCRIPTS, 300), bool), "logs": rng.normal(size=(langid.BUCKETS, 300)).astype(np.float32)}
    text = " ".join("".join(w) for w in rng.choice(list("abcdefgh"), (60000, 5)))
    tracemalloc.start()
    parts = list(langid.long_path(text, model))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(p) for p, _ in parts) == 60000 and len(parts) > 10 and peak < 150e6  # all scores at once would be 72 MB, and three such arrays were held
