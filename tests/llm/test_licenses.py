"""Notices that no line shows: wrapped, in the midst of a line, in full licence texts."""

import textwrap

import pytest

from ampliq.llm import licenses

PROSE = "\n".join(f"line {i} tells of rivers, mills and the roads under the hills near town {i}" for i in range(12))
MIT = """MIT License

Copyright (c) 2024 Foo Corp

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""


def scan(spark, texts):
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(r["license"], r["dice_milli"], r["n_hits"]) for r in sorted(rows)]


@pytest.mark.parametrize("width", [24, 72])
def test_wrapped_notices(spark, width):
    known = licenses.TEMPLATES + licenses.HEADS
    found = scan(spark, [f"{PROSE}\n{textwrap.fill(body, width)}\n{PROSE}" for _, body in known])
    assert [f[0] for f in found] == [name for name, _ in known]
    assert all(f[1] >= licenses.LEAST and f[2] >= 1 for f in found)


def test_embedded_and_full_texts(spark):
    short = "Copyright 2024 Foo Corp. All rights reserved. Released under the MIT License."
    cc = "so cc by nc 4 0 it is"
    two = f"{PROSE} {short} {PROSE} {short} {PROSE}".replace("\n", " ")
    found = scan(spark, [short, MIT, f"{PROSE}\n{MIT}", two, PROSE, f"{PROSE}\nReleased under the MIT License.\n{PROSE}", "Released under\nthe MIT License.", "Licensed " + cc])
    assert found[0] == ("MIT", 1000, 1)
    assert found[1][:2] == found[2][:2] == ("MIT", 1000) and found[1][2] == found[2][2] == 2
    assert found[3] == ("MIT", 1000, 2)
    assert found[4] == (None, 0, 0)
    assert found[5] == ("MIT", 1000, 1)
    assert found[6] == ("MIT", 1000, 1)
    assert found[7][0] == "CC-BY-NC-4.0"


def test_key_words_miss_no_match():
    for _, body in licenses.TEMPLATES + licenses.HEADS:
        grams = licenses._py_bigrams(body)
        keys = set(licenses._key_words([grams], licenses.LEAST))
        assert sum(keys.isdisjoint(g.split()) for g in grams) < licenses._needed(len(grams), licenses.LEAST)
