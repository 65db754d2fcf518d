"""Ranked search against a plain version, with small slices and bundles, ties and odd rows."""

import math
import random
import re
from collections import Counter

import pytest

from lotwise.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, top):
    tf = [Counter(terms(t)) for _, t in docs]
    df, n = Counter(w for c in tf for w in c), [sum(c.values()) for c in tf]
    many, total = sum(k > 0 for k in n), sum(n)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in wanted.items():
        found = []
        for (doc, _), c, k in zip(docs, tf, n):
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 20 * (50 + 50 * k * many // total))) for w in words if c[w])
            if score > 0 and doc is not None:
                found.append((-score, doc))
        out += [(item, k + 1, doc, -s) for k, (s, doc) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def result(spark, docs, items, top):
    got = ranking.rank(spark.createDataFrame(docs, "doc_id long, text string, row long, item string"), spark.createDataFrame(items, "item_id long, text string, doc_id long"), top)
    return sorted(map(tuple, got.collect()), key=str)


def ask(spark, docs, items, top=5):
    assert result(spark, [(*d, 1, "x") for d in docs], [(*i, 7) for i in items], top) == plain(docs, items, top)


@pytest.mark.parametrize("vocabulary", [0, 1 << 20])
def test_equals_plain_version(spark, monkeypatch, vocabulary):
    """Small slices and bundles, with the vocabulary at hand and joined."""
    for name, value in (("SLICE_DOCS", 60), ("BUNDLE", 3), ("VOCABULARY_BYTES", vocabulary), ("OWNER_SHARES", (50, 10, 4))):
        monkeypatch.setattr(ranking, name, value)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)] + ["É", "é", "x_y", "12"]
    weights = [1000 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.randint(0, 30)))) for k in range(500)]
    docs += [(500 + k, "w7 w200 the copy W3") for k in range(200)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for k in range(12)] + [(90, "w200 w3"), (91, "w0"), (92, "nowhere at-all")]
    ask(spark, docs, items)


def test_odd_rows(spark):
    long = "deep " * 30_000 + "end"
    docs = [(1, None), (2, ""), (3, "a b"), (3, "a b c"), (3, "a b"), (None, "a z"), (4, "A-b_C"), (5, long), (6, "\x00c\x7fd"), (7, "straße STRASSE É")]
    items = [(1, "a b"), (1, "c"), (None, "a"), (2, None), (3, ""), (4, "deep d É"), (5, long)]
    ask(spark, docs, items, 3)
    ask(spark, [], items)
    ask(spark, docs, [])
    ask(spark, [(1, None), (2, "...")], items)


def test_large_sums_are_whole(spark, monkeypatch):
    monkeypatch.setattr(ranking.Slice, "__init__", (lambda f: lambda self, *a: (f(self, *a), setattr(self, "exact", False))[0])(ranking.Slice.__init__))
    ask(spark, [(k, f"a b{k % 3} c{k}") for k in range(40)], [(1, "a b1 c7"), (2, "b2 b0")])
