"""Line dedup against a plain version: runs over task borders, hot lines, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lotwise.llm import lines


def plain(rows, long, many):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n") if doc is not None else ():
            key = lowered(line)
            if len(key) >= long:
                holders[key].add(doc)
    out = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        keep = [x for x in all_lines if doc is None or len(holders[lowered(x)]) < many or len(lowered(x)) < long or max(holders[lowered(x)]) == doc]
        out.append((doc, len(all_lines), len(all_lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def lowered(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(lines.BLANK))


def result(spark, rows, long, many, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = lines.drop_shared_lines(df, long, many)
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()], key=str)


@pytest.mark.parametrize("shuffles", ["1", "3", "40"])
def test_equals_plain_version(spark, shuffles):
    """With many tasks a common line's run covers several of them."""
    rng = random.Random(4)
    pool = ["the one line that all of them hold"] + [f"Shared  line number {k}" for k in range(12)]
    rows = []
    for doc in range(400):
        own = [f"a line of {doc} alone", *rng.choices(pool, [30, *[1] * 12], k=3), rng.choice(["", "  ", "short"])]
        rows.append((doc, "\n".join(f"\t{x.upper()} " if rng.random() < 0.3 else x for x in own)))
    old, adaptive = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(spark, rows, 10, 5) == plain(rows, 10, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_odd_rows(spark):
    long = "x" * 30_000
    rows = [
        (1, None), (2, ""), (3, "\n"), (4, "same line here\nsame line here\nÄ same line"), (5, "same line here "), (6, "SAME LINE HERE\nä same line"), (6, "same line here\nother text line"),
        (6, "same line here\nother text line"), (7, "same line here "), (None, "same line here\nmore"), (None, None), (8, long + "\nsame line here"), (9, long + "\n" * 3000), (10, long), (11, "\x0bsame line here\x1c")]
    for many in (1, 2, 3, 5):
        assert result(spark, rows, 8, many) == plain(rows, 8, many)
    assert result(spark, [], 8, 2) == []


def test_bitmaps_and_other_columns(spark):
    line = "a line that is long enough for this one"
    rows = [(k, f"{k}\n{line}\nend", "kept", 1) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at string, h1 int")
    maps = {r.doc_id: r for r in lines.keep_bitmaps(df, 20, 5).collect()}
    assert sorted(maps) == [0, 1, 2, 3, 4]
    assert np.unpackbits(np.frombuffer(zlib.decompress(maps[0].bitmap), np.uint8), count=3, bitorder="little").tolist() == [1, 0, 1]
    out = lines.drop_shared_lines(df, 20, 5)
    assert out.columns == ["doc_id", "text", "at", "h1", "n_lines", "n_dropped"]
    assert {r.doc_id: r.text for r in out.collect()} == {k: f"{k}\nend" if k < 5 else f"{k}\n{line}\nend" for k in range(6)}


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", -1)
    rows = [(k, f"{k}\nthe same long line in each") for k in range(9)]
    assert result(spark, rows, 12, 5) == plain(rows, 12, 5)
