"""Operator 8: quality classifier without labels, from overlapping heuristics.

Labellers, each for one kind of junk, vote junk (0), good (2) or abstain (1) on each whole text. Spark counts the vote patterns
of all documents; expectation-maximisation on these counts (at most 3 to the number of labellers) estimates the shares of
good texts and of each kind of junk and each labeller's accuracy, how often it votes junk where it votes on texts of a
class, and with them a posterior for each pattern. Rates are free but for a prior that weighs as PRIOR documents; an
abstention tells nothing of the class. (With one class for all junk the kinds, which exclude each other, make it
likelier that most of them are misfires on good texts: 46 % of junk was caught on sf0.1.) A linear scorer over FEATURES hashed features of a text (word shapes, repeats, sizes) learns the posteriors
of at most about SAMPLE documents (by a hash of id and features) and scores every text; it also tells texts on which all
labellers abstain. Each text is read once: its votes and features are a table of their own from then on.

Cases: null and empty texts have score 0 and are not kept; with an empty table there are no rows; each row gives a
row; without two different posteriors the scorer's weights are 0 and all texts with words score 0.5 and are kept.
"""

from __future__ import annotations

import operator
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import map_arrow, saved, table

FEATURES = 1024
SAMPLE = 8000
KEEP = 0.5
#: documents that the prior of a labeller's rates weighs as; its rates of junk votes, for its own kind of junk CATCH
PRIOR, MISFIRE, CATCH = 10.0, 0.01, 0.5
CACHE = 400_000
RUN = re.compile(r"(.)\1+")


@dataclass
class Stats:
    words: int
    symbols: float
    upper: float
    pipes: float
    bangs: float
    repeats: float
    distinct: float
    lines_again: float
    mean_word: float


#: kinds of the first 0x3100 code points: 1 letter or digit, 2 upper-case letter, 3 white space, 0 other; all later ones count as letters
KINDS = np.array([3 if c.isspace() else 2 if c.isupper() else 1 if c.isalnum() or unicodedata.category(c)[0] == "M" else 0 for c in map(chr, range(0x3100))], np.uint8)


def stats(text: str) -> Stats:
    words, n = text.split(), len(text) or 1
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    w = len(words) or 1
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = np.bincount(KINDS[cp[cp < len(KINDS)]], minlength=4)
    return Stats(
        len(words), kind[0] / n, kind[2] / n, text.count("|") / w, text.count("!") / w, sum(map(operator.eq, words, words[1:])) / w,
        len(set(words)) / w, 1 - len(set(lines)) / (len(lines) or 1), (n - kind[3]) / w)


def between(x: float, good: float, junk: float) -> int:
    return 0 if x > junk else 2 if x < good else 1


LABELLERS = {
    "symbols": lambda s: 1 if s.words < 8 else between(s.symbols, 0.045, 0.1),
    "upper case": lambda s: 1 if s.words < 8 else between(s.upper, 0.05, 0.2),
    "table bars": lambda s: between(s.pipes, 0.005, 0.05),
    "exclamation": lambda s: between(s.bangs, 0.05, 0.3),
    "word again": lambda s: between(s.repeats, 0.03, 0.15),
    "few words": lambda s: 1 if s.words < 40 else 0 if s.distinct < 0.3 else 2 if s.distinct > 0.45 else 1,
    "line again": lambda s: between(s.lines_again, 0.05, 0.4) if s.words > 10 else 1,
    "word length": lambda s: 1 if s.words < 20 else 2 if 3 <= s.mean_word <= 7 else 0 if s.mean_word > 12 else 1,
}


def votes(text: str | None) -> str | None:
    if not text or text.isspace():
        return None
    s = stats(text)
    return "".join(str(f(s)) for f in LABELLERS.values())


def label_model(patterns: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """P(good) of each vote pattern by expectation-maximisation over good and a kind of junk for each labeller.

    Labellers are taken as independent given the class; each class has its own rates of junk votes among a labeller's votes.
    """
    if not patterns:
        return {}
    names = sorted(patterns)
    v = np.array([[int(c) for c in p] for p in names])
    n = np.array([patterns[p] for p in names], float)
    junk, passed = (v == 0).astype(float), (v == 2).astype(float)
    # at first a junk vote outweighs all good ones, as labellers look for different kinds: its text is of the voters' kinds
    good = np.where(junk.any(1), 1e-3, np.where(passed.any(1), 1 - 1e-3, 0.5))[:, None]
    kinds = np.where(junk.any(1)[:, None], junk, 1.0)
    p = np.hstack([good, (1 - good) * kinds / kinds.sum(1, keepdims=True)])
    before = np.full((p.shape[1], v.shape[1]), MISFIRE)
    before[np.arange(1, p.shape[1]), np.arange(v.shape[1])] = CATCH
    for _ in range(rounds):
        weight = (p * n[:, None]).T
        share = (weight.sum(1) + 1) / (n.sum() + len(weight))
        rate = (weight @ junk + PRIOR * before) / (weight @ (junk + passed) + PRIOR)
        z = np.log(share)[None, :] + junk @ np.log(rate).T + passed @ np.log(1 - rate).T
        new = np.exp(z - z.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return dict(zip(names, p[:, 0].tolist()))


def shape(word: str) -> int:
    s = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return zlib.crc32(RUN.sub(r"\1", s)[:8].encode()) % (FEATURES - 64)


class Shapes(dict):
    """Word -> hashed shape, held for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = got = shape(word)
        return got


SHAPES = Shapes()


def features(text: str) -> tuple[list[int], list[float]]:
    """Indices and values. The last 64 features are bins of the repeats, distinct words, lines and sizes."""
    words = text.split()
    n = len(words) or 1
    count = Counter(map(SHAPES.__getitem__, words))
    lines = [x for x in text.split("\n") if x.strip()]
    bins = (
        min(15, int(100 * sum(map(operator.eq, words, words[1:])) / n)),
        16 + min(15, int(16 * len(set(words)) / n)),
        32 + min(15, int(16 * (1 - len(set(lines)) / (len(lines) or 1)))),
        48 + min(15, n.bit_length()),
    )
    return [*count, *(FEATURES - 64 + b for b in bins)], [*(3 * (c / n) ** 0.5 for c in count.values()), 1.0, 1.0, 1.0, 1.0]


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, at: np.ndarray, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores of rows whose features stand one after another."""
        row = np.repeat(np.arange(len(lengths)), lengths)
        z = np.bincount(row, weights=self.weights[at] * x, minlength=len(lengths)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; classes weigh alike."""
    w, b, vw, vb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    if not len(y) or y.max() - y.min() < 1e-3:
        return w, b
    weight = y / max(y.mean(), 1e-6) + (1 - y) / max((1 - y).mean(), 1e-6)
    weight /= weight.sum()
    for _ in range(rounds):
        g = weight * (1 / (1 + np.exp(-np.clip(x @ (w + 0.9 * vw) + b + 0.9 * vb, -30, 30))) - y)
        vw, vb = 0.9 * vw - 0.3 * (x.T @ g + l2 * w), 0.9 * vb - 0.3 * g.sum()
        w, b = w + vw, b + vb
    return w, b


def read(docs: DataFrame) -> DataFrame:
    """(doc_id, votes, at, x) of every row, a table: votes and features, null and empty for texts without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t if t and not t.isspace() else None for t in batch.column(1).to_pylist()]
        got = [features(t) if t else ([], []) for t in texts]
        return {
            "doc_id": batch.column(0), "votes": [votes(t) for t in texts],
            "at": pa.array([g[0] for g in got], pa.list_(pa.int16())), "x": pa.array([g[1] for g in got], pa.list_(pa.float32())),
        }

    return saved(map_arrow(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {kind}, votes string, at array<short>, x array<float>"), "votes")


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], Scorer]:
    """rows: those of read."""
    some = rows.filter("votes is not null")
    counts = {r.votes: r.n for r in some.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    posterior = label_model(counts)
    total = sum(counts.values()) or 1
    few = some.filter(F.pmod(F.xxhash64("doc_id", "at"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / total)) + 1)
    got = few.select("votes", "at", "x").limit(2 * sample).toArrow()  # about SAMPLE rows
    x, y = np.zeros((len(got), FEATURES)), np.array([posterior[v] for v in got.column("votes").to_pylist()])
    at, values = got.column("at").combine_chunks(), got.column("x").combine_chunks()
    x[np.repeat(np.arange(len(got)), np.diff(at.offsets)), at.flatten()] = values.flatten()
    return posterior, Scorer(*train(x, y))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, votes, weak, score, keep): weak is the votes' posterior of good, score the linear scorer's."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = read(docs)
    posterior, scorer = fit(rows)
    sent = docs.sparkSession.sparkContext.broadcast((posterior, scorer))  # at most 3 to the number of labellers, and FEATURES numbers

    def run(batch: pa.RecordBatch) -> dict:
        seen, at, x = batch.column(1).to_pylist(), batch.column(2), batch.column(3)
        score = sent.value[1].score(np.asarray(at.flatten()), np.asarray(x.flatten()), np.asarray(at.value_lengths()))
        score = np.where([v is None for v in seen], 0.0, score)
        return {
            "doc_id": batch.column(0), "votes": batch.column(1), "weak": [sent.value[0].get(v) if v else None for v in seen],
            "score": score, "keep": [v is not None and s >= KEEP for v, s in zip(seen, score.tolist())],
        }

    return map_arrow(rows, run, f"doc_id {kind}, votes string, weak double, score double, keep boolean")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "score", F.col("keep").cast("int").alias("predicted"), "keep", "weak", "votes")
