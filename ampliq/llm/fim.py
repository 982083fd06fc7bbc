"""Fill-in-middle: texts cut in three and put together in another order.

Cuts are counted in code points, texts are kept as UTF-8.  A sparse index of
exceptions, the characters of more than one byte with the bytes that they have
in excess, turns one count into the other: between exceptions a code point is a
byte, so a search among them and an addition give a cut's byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliq.llm.common import text_or_empty

#: Marks of prefix, suffix and middle; shares in percent; what is hashed before an id.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_PCT, SPM_PCT = 10, 20
SEED = "1:"
#: Bytes looked at together when exceptions are found.
WINDOW = 1 << 22


class CutIndex:
    """The characters of more than one byte among ``data``, UTF-8: where they are and how many bytes in excess come before each."""

    def __init__(self, data: np.ndarray) -> None:
        at, excess = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low in range(0, len(data), WINDOW):
            part = data[low : low + WINDOW]
            lead = np.flatnonzero(part >= 0xC0)
            at.append(lead + low)
            excess.append(1 + (part[lead] >= 0xE0).astype(np.int64) + (part[lead] >= 0xF0))
        self.byte = np.concatenate(at)
        self.before = np.concatenate(([0], np.cumsum(np.concatenate(excess))))
        self.char = self.byte - self.before[:-1]

    def to_char(self, byte: np.ndarray) -> np.ndarray:
        """Code points before a byte at which a character begins (or the data end)."""
        return byte - self.before[np.searchsorted(self.byte, byte)]

    def to_byte(self, char: np.ndarray) -> np.ndarray:
        """The byte at which a code point begins."""
        return char + self.before[np.searchsorted(self.char, char)]


def cut_points(key: bytes, n: int) -> tuple[int, int, int, int]:
    """(prefix's end, middle's end, h3, h4) for a document's hash input and code points."""
    digest = hashlib.sha256(key).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return low, high, h3, h4


def arrange(text: bytes, first: int, second: int, form: str) -> bytes:
    """``text``, cut at two bytes, in the order of a form: psm, spm or plain."""
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)) if form == "spm" else text


def restore(output: bytes, form: str) -> bytes:
    """The text of an output.  It holds each mark once: texts with a mark stay plain, and no mark can arise where a part meets one."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, b, c = (output.index(mark) for mark in (one, two, MIDDLE))
    parts = {one: output[a + len(one) : b], two: output[b + len(two) : c]}
    return parts[PREFIX] + output[c + len(MIDDLE) :] + parts[SUFFIX]


def transform_batch(keys: list[str], texts: pa.Array, plain_pct: int = PLAIN_PCT, spm_pct: int = SPM_PCT) -> list[tuple[int, str, int | None, int | None, bytes]]:
    """(code points, form, prefix's and middle's code points, output) of each text; one index serves all texts of the array."""
    held = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, values = held.buffers()
    ends = np.frombuffer(offsets, np.int64)[held.offset : held.offset + len(held) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    index = CutIndex(data[: ends[-1]])
    at = index.to_char(ends)
    plans = [cut_points((SEED + key).encode(), int(n)) for key, n in zip(keys, np.diff(at), strict=True)]
    cuts = index.to_byte(np.array([p[:2] for p in plans], np.int64).reshape(-1, 2) + at[:-1, None]) - ends[:-1, None]
    out = []
    for k, (low, high, h3, h4) in enumerate(plans):
        text, n = data[ends[k] : ends[k + 1]].tobytes(), int(at[k + 1] - at[k])
        plain = not text or h3 % 100 >= 100 - plain_pct or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE))
        form = "plain" if plain else "spm" if h4 % 100 < spm_pct else "psm"
        out.append((n, form, None if plain else low, None if plain else high - low, arrange(text, *cuts[k].tolist(), form)))
    return out


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plain_pct: int = PLAIN_PCT, spm_pct: int = SPM_PCT, with_output: bool = False) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, and ``output`` if wanted.

    Cuts and form depend on the id and the text's code points alone, so equal
    rows are transformed alike and reruns agree.  A null text is empty, a null
    id is hashed as an empty one; empty texts and those with a mark stay plain,
    with null in prefix_chars and middle_chars; parts may be empty.  The text is
    rebuilt from each output.  Repeated rows stay; other columns are ignored; an
    empty table gives an empty result; a long text takes a few times its bytes.
    Nothing is shuffled.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[doc_id].cast("string"), F.lit("")).alias("key"), text_or_empty(docs[text]).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = transform_batch(batch.column("key").to_pylist(), batch.column("text"), plain_pct, spm_pct)
            sha = lambda b: hashlib.sha256(b).hexdigest()
            n, form, prefix, middle, output = zip(*done, strict=True) if done else ([],) * 5
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                       pa.array(map(sha, output), pa.string()), pa.array([sha(restore(o, f)) for o, f in zip(output, form, strict=True)], pa.string())]
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
            if with_output:
                columns.append(pa.array(output, pa.binary()).cast(pa.string()))
                names.append("output")
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * with_output)


ORACLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM d),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || substr(body, 1, a) || '<S>' || substr(body, b + 1) || '<M>' || substr(body, a + 1, b - a) ELSE '<S>' || substr(body, b + 1) || '<P>' || substr(body, 1, a) || '<M>' || substr(body, a + 1, b - a) END) AS output_sha256, sha256(body) AS restored_sha256 FROM f"""
