"""Operator 7: language identification by error-correcting output codes.

Each language has a binary codeword (the rows of an exhaustive code up to MAX_EXHAUSTIVE languages, else of a fixed
pseudo-random one). For each bit a binary classifier over hashed character n-grams (1 to 3 of the lower-cased text)
tells languages with that bit from the others: naive Bayes weights from counts that Spark gathers over the training
rows. Decoding sums, for each codeword, the logistic losses of the bits weighted by each bit's accuracy margin, and
takes the smallest; a small gap to the second smallest flags an ambiguous text.

The fit reads at most about MAX_DOCS documents of a language (by a hash of the id, whole texts); its model is
BUCKETS x bits numbers, whatever the size of the input. Prediction reads every whole text and shuffles nothing.

Cases: null texts and texts without a letter are "und" with score 0; without training rows all texts are; ties go to
the language that sorts first; every input row gives one row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import held_out, map_arrow, small_batches, table, tidy

BUCKETS = 1 << 14
MAX_DOCS = 3000
MAX_EXHAUSTIVE = 6
#: least gap between the best two codewords' mean losses, as a share of the loss range
AMBIGUOUS = 0.05


def grams(text: str) -> np.ndarray:
    """Hash buckets of the 1- to 3-grams of a text's letters and spaces; empty if it has no letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = (cp >= 0xC0) | ((cp >= 97) & (cp <= 122)) | (cp == 0xAA) | (cp == 0xB5) | (cp == 0xBA)
    if not letter.any() or not any(map(str.isalpha, text)):
        return np.empty(0, np.int64)
    cp = np.where(letter, cp, np.uint32(32)).astype(np.uint64)
    cp = cp[np.append(True, (cp[1:] != 32) | (cp[:-1] != 32))]  # runs of other characters count as one space
    a, b, c = cp, cp[:-1] * np.uint64(0x1F123BB5) + cp[1:], None
    c = b[:-1] * np.uint64(0x1F123BB5) + cp[2:] if len(cp) > 2 else cp[:0]
    all_ = np.concatenate([a, b + np.uint64(1 << 40), c + np.uint64(1 << 41)])
    return ((all_ * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)


def codewords(k: int) -> np.ndarray:
    """k rows of bits; any two rows differ in about half of them."""
    if k <= MAX_EXHAUSTIVE:
        columns = [[(j >> i) & 1 for i in range(k)] for j in range(1, max(2, 1 << (k - 1)))]
        return np.array(columns, np.int8).T.copy()
    bits = int(np.ceil(10 * np.log2(k)))
    tries = [np.random.default_rng(s).integers(0, 2, (k, bits), np.int8) for s in range(20)]
    apart = lambda m: min(int((m[i] != m[j]).sum()) for i in range(k) for j in range(i))
    return max(tries, key=apart)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weight: np.ndarray

    def losses(self, text: str | None) -> np.ndarray | None:
        """Mean weighted loss of each codeword, 0 to 1; None for a text that can't be told."""
        g = grams(text) if text else ()
        if not len(g) or not self.langs:
            return None
        count = np.bincount(g, minlength=BUCKETS)
        margin = (count @ self.weights) / len(g) * min(len(g), 40)
        sign = np.where(self.code == 1, 1.0, -1.0)
        loss = 1 / (1 + np.exp(np.clip(sign * margin[None, :], -30, 30)))
        return loss @ self.bit_weight

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        loss = self.losses(text)
        if loss is None:
            return "und", 0.0, True
        order = np.argsort(loss, kind="stable")
        gap = float(loss[order[1]] - loss[order[0]]) if len(order) > 1 else 1.0
        return self.langs[order[0]], float(1 - loss[order[0]]), gap < AMBIGUOUS


def fit(train: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """train: (doc_id, text, lang); rows without a language are left out."""
    train = train.filter(F.col("lang").isNotNull()).select("doc_id", F.col("text").cast("string"), "lang")
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not sizes:
        return Model([], np.zeros((0, 1)), np.zeros((BUCKETS, 1)), np.ones(1))
    langs = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, max_docs / sizes[k]))])
    picked = train.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.get(F.array(F.try_element_at(share, "lang")), F.lit(0)) * (1 << 20))

    def run(batch: pa.RecordBatch) -> dict:
        by: dict[str, np.ndarray] = {}
        for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            g = grams(text) if text else ()
            if len(g):
                by[lang] = by.get(lang, 0) + np.bincount(g, minlength=BUCKETS) / len(g) * min(len(g), 400)
        at = {k: np.flatnonzero(v) for k, v in by.items()}
        return {
            "lang": [k for k, i in at.items() for _ in range(len(i))],
            "bucket": np.concatenate([np.empty(0, np.int64), *at.values()]),
            "n": np.concatenate([np.empty(0), *[by[k][i] for k, i in at.items()]]),
        }

    counts = map_arrow(picked, run, "lang string, bucket long, n double", rows=20_000).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toPandas()  # at most BUCKETS rows a language
    n = np.zeros((len(langs), BUCKETS))
    n[[langs.index(k) for k in got["lang"]], got["bucket"]] = got["n"]
    p = (n + 0.5) / (n + 0.5).sum(axis=1, keepdims=True)
    code = codewords(len(langs))
    weights = np.zeros((BUCKETS, code.shape[1]))
    for bit in range(code.shape[1]):
        one = code[:, bit] == 1
        if one.any() and not one.all():
            weights[:, bit] = np.log(p[one].mean(axis=0)) - np.log(p[~one].mean(axis=0))
    # a bit weighs as much as the mean margin by which it tells the languages' own n-grams
    margin = np.abs(p @ weights) * np.ones_like(code)
    bit_weight = margin.mean(axis=0) + 1e-9
    return Model(langs, code, weights, bit_weight / bit_weight.sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits numbers
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        got = [sent.value.predict(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "ambiguous": [g[2] for g in got]}

    return map_arrow(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs without texts that are rejected: "und", those that no codeword can be told for. A model that was fitted on no
    row knows no language and rejects only texts without a letter."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        for batch in batches:
            model = sent.value
            keep = [model.predict(t)[0] != "und" if model.langs else bool(t) and len(grams(t)) > 0 for t in batch.column(names.index("text")).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
