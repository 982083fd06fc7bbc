"""Language identification of mixed-language text.

Words are scored by hashed character trigrams, learned per language.  The
script of a word's letters narrows its candidate languages; a Viterbi pass with
a penalty for each switch then labels spans of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliq.llm.common import fold

#: Buckets of trigrams, cost of a switch, and characters handled at once.
BUCKETS, SWITCH, CHUNK = 1 << 15, 12.0, 1 << 18
#: The first code point of each range of a script; ranges end where the next begins.
SCRIPTS = (
    (0x0000, "other"), (0x0041, "latin"), (0x005B, "other"), (0x0061, "latin"), (0x007B, "other"), (0x00C0, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"),
    (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"))
#: A script is a language's if at least this share of its letters are of it.
SCRIPT_SHARE = 0.001
#: Languages that a task counts at once, and up to which a model's scores are a matrix (33 MB).
LANGS = 256
#: Words times languages that are scored at once.
CELLS = 1 << 22


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@cache
def _scripts() -> tuple[np.ndarray, np.ndarray]:
    names = sorted({name for _, name in SCRIPTS})
    return np.array([start for start, _ in SCRIPTS]), np.array([names.index(name) for _, name in SCRIPTS])


N_SCRIPTS = len({name for _, name in SCRIPTS})


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _trigrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word of each trigram, its bucket, script of each letter's word) for letters in ``codes``; other characters end words."""
    c = np.concatenate((np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32)))
    letter = _letters()[c]
    c = np.where(letter, c, 0).astype(np.uint64)
    mixed = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    mixed = ((mixed ^ (mixed >> np.uint64(15))) * np.uint64(0x2C1B3C6D)) & np.uint64(0xFFFFFFFF)
    inner = letter[1:-1]
    begins = inner & ~letter[:-2]
    word = np.cumsum(begins) - 1
    starts, of = _scripts()
    script = of[np.searchsorted(starts, codes[inner], "right") - 1] if inner.any() else np.empty(0, np.int64)
    return word[inner], (mixed[inner] >> np.uint64(17)).astype(np.int64), script


def train(docs: DataFrame, text: str, lang: str) -> dict:
    """Trigram and script counts per language over all rows with a text and a language, as scores: {"langs", "base", "allowed", "logs" or "cells"}.

    Tasks add up their rows first, so a hot language costs no more than any
    other.  Every language is learnt, however many there are: up to LANGS their
    scores are a matrix of buckets and languages; of more only the buckets that
    a language has are kept, by bucket, besides each language's score of all
    others.  What reaches the driver is a few hundred KB a language at most.
    Rows without a letter count nothing; without any row the model has no
    language.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for name, own in sums.items():
                used = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(own[used], pa.int64())], ["lang", "bucket", "n"])
            sums.clear()

        for batch in batches:
            for body, name in zip(batch.column(0), batch.column(1), strict=True):
                if len(sums) >= LANGS and name.as_py() not in sums:
                    yield from counted()
                own = sums.setdefault(name.as_py(), np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                for codes in _slices(body.as_py(), CHUNK):
                    _, bucket, script = _trigrams(codes)
                    own += np.bincount(np.concatenate((bucket, script + BUCKETS)), minlength=len(own))
        yield from counted()

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        at, n = (table.column(c).to_numpy() for c in ("bucket", "n"))
        return pa.table([pa.array([key[0].as_py()]), pa.array([at.astype(np.int32).tobytes()]), pa.array([n.astype(np.int64).tobytes()])], ["lang", "at", "n"])

    rows = docs.select(docs[text].alias("text"), docs[lang].alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    whole = counts.groupBy("lang").applyInArrow(packed, "lang string, at binary, n binary")  # a group has as many rows as there are buckets and scripts
    langs, base, allowed, held = [], [], [], []
    for name, at, n in sorted(whole.toLocalIterator(), key=lambda r: r[0]):
        at, n = np.frombuffer(at, np.int32), np.frombuffer(n, np.int64)
        seen, script = at < BUCKETS, np.zeros(N_SCRIPTS)
        total = n[seen].sum() + 0.5 * BUCKETS
        script[at[~seen] - BUCKETS] = n[~seen]
        held.append((at[seen], np.log((n[seen] + 0.5) / total)))
        langs.append(name), base.append(np.log(0.5 / total)), allowed.append(script >= SCRIPT_SHARE * max(1, script.sum()))
    out = {"langs": langs, "base": np.array(base), "allowed": np.array(allowed).reshape(-1, N_SCRIPTS).T if langs else np.ones((N_SCRIPTS, 1), bool)}
    out["allowed"] = out["allowed"] | ~out["allowed"].any(1, keepdims=True)  # a script that none has leaves all
    if len(langs) <= LANGS:
        logs = np.tile(out["base"], (BUCKETS, 1)) if langs else np.zeros((BUCKETS, 1))
        for k, (at, log) in enumerate(held):
            logs[at, k] = log
        return out | {"logs": logs.astype(np.float32)}
    bucket, lang_of = np.concatenate([at for at, _ in held]), np.repeat(np.arange(len(held), dtype=np.int32), [len(at) for at, _ in held])
    more = np.concatenate([log - b for (_, log), b in zip(held, base, strict=True)]).astype(np.float32)
    order = np.argsort(bucket, kind="stable")
    return out | {"cells": (np.searchsorted(bucket[order], np.arange(BUCKETS + 1)), lang_of[order], more[order])}


def _slices(text: str, most: int) -> Iterator[np.ndarray]:
    """The lower-cased code points of ``text``, some at a time; cuts lie behind a character that is no letter, if there is one among ``most``."""
    at = 0
    while at < len(text):
        end = at + most
        if end < len(text):
            gap = next((k for k in range(min(end, len(text)) - 1, at, -1) if not text[k].isalpha()), None)
            end = gap + 1 if gap is not None else end
        yield _codes(text[at:end])
        at = end


def _slice_size(model: dict) -> int:
    """Characters whose words times languages stay within CELLS, even if a word were two characters."""
    return max(1 << 10, min(CHUNK, 2 * CELLS // max(1, len(model["langs"]))))


def _scores(codes: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    word, bucket, script = _trigrams(codes)
    n = max(1, len(model["langs"]))
    if not len(word):
        return np.empty((0, n), np.float32), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    letters = np.diff(np.concatenate((first, [len(word)])))
    if "logs" in model:
        score = np.add.reduceat(model["logs"][bucket], first, axis=0)
    else:  # every language by its letters, and those that have a trigram by what it adds
        starts, lang, more = model["cells"]
        size = starts[bucket + 1] - starts[bucket]
        at = np.repeat(starts[bucket] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        score = letters[:, None] * model["base"] + np.bincount(np.repeat(word, size) * n + lang[at], more[at], len(first) * n).reshape(-1, n)
    return np.where(model["allowed"][script[first]], score, score - 50).astype(np.float32), letters


def word_scores(text: str, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(words x languages scores, letters of each word); languages not of the word's script lose 50."""
    parts = [_scores(codes, model) for codes in _slices(text, _slice_size(model))]
    parts = [p for p in parts if len(p[1])] or [(np.empty((0, max(1, len(model["langs"]))), np.float32), np.empty(0, np.int64))]
    return np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])


def _advance(flat: np.ndarray, state: np.ndarray | None, switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state after the last word, best language before each word, packed bits: whether a language is reached by a switch) of one text's next words."""
    flat = flat - flat.max(1, keepdims=True)
    back, switched = np.zeros(len(flat), np.int32), np.zeros((len(flat), -(-flat.shape[1] // 8)), np.uint8)
    for t, own in enumerate(flat):
        if state is None:
            state = own
            continue
        back[t] = best = int(state.argmax())
        top = state[best] - np.float32(switch)
        switched[t] = np.packbits(top > state)
        state = np.maximum(state, top) + own
        state -= state.max()
    return state, back, switched


def long_path(text: str, model: dict, switch: float = SWITCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(labels, letters) of the best path's words, slice by slice from the text's end.

    The same path as that of ``viterbi`` over all words.  Going forward only the
    state before each slice is kept; going back a slice is scored again.
    """
    slices, states, state = [], [], None
    for codes in _slices(text, _slice_size(model)):
        scores, letters = _scores(codes, model)
        if len(letters):
            slices.append(codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"))
            states.append(state)
            state = _advance(scores, state, switch)[0]
    now = int(state.argmax()) if slices else 0
    for held, before in zip(slices[::-1], states[::-1], strict=True):
        scores, letters = _scores(np.frombuffer(held.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32), model)
        _, back, switched = _advance(scores, before, switch)
        path = np.empty(len(letters), np.int64)
        for t in range(len(path) - 1, -1, -1):
            path[t] = now
            if switched[t, now >> 3] >> (7 - (now & 7)) & 1:
                now = int(back[t])
        yield path, letters


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """Best label of every word; all texts advance together, longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    if not len(lengths) or not lengths[0]:
        return [np.empty(0, np.int64) for _ in scores]
    offsets = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    flat = np.concatenate([scores[i] for i in order])
    flat = flat - flat.max(1, keepdims=True)
    live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")  # texts with a word at this step
    back, switched = np.zeros(len(flat), np.int64), np.zeros(flat.shape, bool)
    state = flat[offsets[: live[0]]]
    ends = np.zeros(len(lengths), np.int64)
    for t in range(1, lengths[0]):
        n = live[t]
        if n < len(state):
            ends[n : len(state)] = state[n:].argmax(1)
            state = state[:n]
        best = state.argmax(1)
        top = state[np.arange(n), best][:, None] - switch
        at = offsets[:n] + t
        back[at] = best
        switched[at] = top > state
        state = np.maximum(state, top) + flat[at]
        state -= state.max(1, keepdims=True)
    ends[: len(state)] = state.argmax(1)
    labels = np.zeros(len(flat), np.int64)
    now = np.zeros(len(lengths), np.int64)
    for t in range(lengths[0] - 1, -1, -1):
        n = live[t]
        more = live[t + 1] if t + 1 < lengths[0] else 0
        now[more:n] = ends[more:n]
        at = offsets[:n] + t
        labels[at] = now[:n]
        if t:
            now[:n] = np.where(switched[at, now[:n]], back[at], now[:n])
    out: list = [None] * len(scores)
    for k, i in enumerate(order):
        out[i] = labels[offsets[k] : offsets[k] + lengths[k]]
    return out


def _groups(texts: list[str | None], most: int) -> Iterator[list[str]]:
    """Texts in order, in groups that end where they pass ``most`` characters; a longer text is a group of its own."""
    part: list[str] = []
    size = 0
    for text in texts:
        if part and len(text or "") > most:
            yield part
            part, size = [], 0
        part.append(text or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _summary(parts: list[tuple[np.ndarray, np.ndarray]], names: list[str], spans: bool) -> tuple[str, float, int, list[dict]]:
    """(language, share of the letters, number of spans, spans) of a path in parts."""
    share, runs, words = np.zeros(max(1, len(names))), [], 0
    for path, letters in parts:
        if not len(path):
            continue
        share += np.bincount(path, letters, len(names))
        first = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
        if runs and runs[-1][0] == path[0]:
            first = first[1:]
        runs += [(int(path[i]), words + int(i)) for i in first] if spans else [(int(path[i]), 0) for i in first]
        if not spans and runs:
            runs, words = [runs[-1]], words + len(first)  # only their number is wanted
        elif spans:
            words += len(path)
    if not runs:
        return "und", 0.0, 0, []
    ends = [at for _, at in runs[1:]] + [words]
    held = [{"lang": names[k], "first_word": at, "words": end - at} for (k, at), end in zip(runs, ends, strict=True)] if spans else []
    return names[int(share.argmax())], float(share.max() / share.sum()), len(runs) if spans else words, held


def identify(docs: DataFrame, model: dict, switch: float = SWITCH, spans: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Language of every whole text: that of most letters on the best path.

    Columns: doc_id, lang_pred, score (share of the letters), n_spans and,
    with ``spans``, the runs of words as array<struct<lang, first_word, words>>.
    ``und`` with score 0 for null texts, texts without a letter, and where the
    model has no language.  Of equal scores and shares the first language by
    name wins.  Repeated rows stay; other columns, whatever their names, are
    ignored; an empty table gives an empty result.  Texts are labelled together
    within CELLS words times languages; a longer one by itself in slices, so its
    words times languages are never in memory at once.
    """
    schema = "doc_id long, lang_pred string, score double, n_spans long" + (", spans array<struct<lang: string, first_word: int, words: int>>" if spans else "")
    names = model["langs"]
    most = 4 * _slice_size(model)

    def labelled(texts: list[str]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        if not names:
            return [[]] * len(texts)
        if len(texts) == 1 and len(texts[0]) > most:
            return [list(long_path(texts[0], model, switch))[::-1]]
        scored = [word_scores(t, model) for t in texts]
        return [[(path, letters)] for path, (_, letters) in zip(viterbi([x for x, _ in scored], switch), scored, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(1).to_pylist(), most):
                keys = batch.column(0).slice(at, len(texts))
                at += len(texts)
                lang, score, n, runs = zip(*(_summary(parts, names, spans) for parts in labelled(texts)), strict=True)
                columns = [keys.cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64())]
                if spans:
                    columns.append(pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "n_spans", "spans"][: len(columns)])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema)


def language_id(docs: DataFrame, switch: float = SWITCH, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the folds other than 2 of ``docs`` (all of their rows) and predict all rows: doc_id, held_out, lang_pred, score, n_spans.

    Null texts, ties, repeated rows, very long texts, an empty table and columns
    of clashing names are treated as in ``identify``; rows without a language or
    a text aren't learnt from.
    """
    plain = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), docs[lang].alias("lang"))
    model = train(plain.where(fold("doc_id") != 2), "text", "lang")
    out = identify(plain, model, switch)
    return out.select("doc_id", (fold("doc_id") == 2).alias("held_out"), "lang_pred", "score", "n_spans")
