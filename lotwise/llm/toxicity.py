"""Operator 1: toxicity scores from a learned lexicon, Levenshtein automata and context windows.

Fit (on at most about MAX_DOCS labelled documents a class, by a hash of the id; whole texts):
1. Spark counts, per class, the documents that hold each word and each word stem (4 to 7 first letters).
2. A term weighs its smoothed log odds: how much likelier a toxic document holds it than a clean one. The lexicon takes
   terms of at least MIN_ODDS, greedily by the toxic documents they add, so that a group of copies does not bring its
   ordinary words in; a term that a few clean documents hold too can be one.
3. Words and long stems get an edit budget (0, 1 or 2 by length). The Levenshtein automaton of the lexicon's trie is
   built lazily as one deterministic automaton: a state is the set of (trie node, edits), most words die early.
4. Context: each hit is direct, misspelled or quoted (between an opening and a closing mark, or after a word that reports
   speech); a logistic regression on counts of these, on the different words and the weights of the different terms among
   them, and on their densities, gives the score.

Scoring reads every whole text and shuffles nothing. A document counts for at most three terms and a term needs MIN_DOCS of
them, so the lexicon has at most about 3 * MAX_DOCS / MIN_DOCS terms.

Cases: null and empty texts, and texts without hits, get the model's score for no hits; without labelled rows of both
classes every score is 0; labels null in toxic are left out; a repeated label row counts as often; every input row
gives one row.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import held_out, map_arrow, table

MAX_DOCS = 6000
#: least toxic documents of a term, least ratio of its shares of toxic and clean documents
MIN_DOCS, MIN_ODDS = 4, 8.0
STEMS = range(4, 8)
CONTEXT = 6
#: a quoted hit is at most so many characters before the closing mark
NEAR_MARK = 60
WORD = re.compile(r"[^\W\d_]+")
QUOTES = re.compile(r"[\"“”«»„]")
#: words that report what others say; fixed values
REPORTS = frozenset("said says quote quoted quoting called calls word term dijo dice palabra sagte sagt wort dit mot".split())
CACHE = 400_000


def budget(term: str) -> int:
    n = len(term.rstrip("*"))
    return 0 if n < 5 or (term.endswith("*") and n < 7) else 1 if n < 10 else 2


class Automaton:
    """Levenshtein automaton of a trie of terms; "stem*" accepts any ending after the stem."""

    def __init__(self, terms: list[str]):
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, bool, int] | None] = [None]
        self.depth_budget: list[int] = [0]
        for t, term in enumerate(terms):
            node, most = 0, budget(term)
            self.depth_budget[0] = max(self.depth_budget[0], most)
            for ch in term.rstrip("*"):
                nxt = self.kids[node].get(ch)
                if nxt is None:
                    nxt = self.kids[node][ch] = len(self.kids)
                    self.kids.append({})
                    self.ends.append(None)
                    self.depth_budget.append(0)
                node = nxt
                self.depth_budget[node] = max(self.depth_budget[node], most)
            self.ends[node] = (t, term.endswith("*"), most)
        start = self.close({0: 0})
        self.states = {start: 0}
        self.sets = [start]
        self.moves: list[dict[str, int]] = [{}]
        self.accepts: list[tuple[int, int, bool] | None] = [self.accept(start)]

    def close(self, nodes: dict[int, int]) -> frozenset:
        """Skipping letters of the term; keeps the fewest edits of each node."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            for kid in self.kids[node].values():
                if e + 1 <= self.depth_budget[kid] and nodes.get(kid, 99) > e + 1:
                    nodes[kid] = e + 1
                    todo.append((kid, e + 1))
        return frozenset(nodes.items())

    def accept(self, state: frozenset) -> tuple[int, int, bool] | None:
        """(edits, term, stem) of the best term that ends in the state."""
        found = [(e, self.ends[n][0], self.ends[n][1]) for n, e in state if self.ends[n] and e <= self.ends[n][2]]
        return min(found) if found else None

    def step(self, at: int, ch: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.sets[at]:
            for letter, kid in self.kids[node].items():
                cost = e + (letter != ch)
                if cost <= self.depth_budget[kid] and out.get(kid, 99) > cost:
                    out[kid] = cost
            if e + 1 <= self.depth_budget[node] and out.get(node, 99) > e + 1:
                out[node] = e + 1
        if not out:
            return -1
        key = self.close(out)
        nxt = self.states.get(key)
        if nxt is None:
            nxt = self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.accepts.append(self.accept(key))
        return nxt

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, None if none is near enough."""
        at, stem = 0, None
        for ch in word:
            nxt = self.moves[at].get(ch)
            if nxt is None:
                nxt = self.moves[at][ch] = self.step(at, ch)
            if nxt < 0:
                return stem
            at = nxt
            end = self.accepts[at]
            if end and end[2] and (stem is None or end[:2] < stem):
                stem = end[:2]
        end = self.accepts[at]
        return min(filter(None, (stem, end and end[:2])), default=None)


@dataclass
class Model:
    terms: list[str]
    odds: list[float] = field(default_factory=list)
    weights: np.ndarray | None = None
    automaton: Automaton | None = field(default=None, repr=False)
    cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"terms": self.terms, "odds": self.odds, "weights": self.weights, "automaton": None, "cache": {}}

    def look_up(self, word: str) -> tuple[int, int] | None:
        if self.automaton is None:
            self.automaton = Automaton(self.terms)
        return self.automaton.match(word)

    def hits(self, text: str) -> tuple[list[tuple[int, int, int]], list[str]]:
        """[(word index, edits, term)] and the text's words."""
        words = WORD.findall(text)
        cache = self.cache
        new = set(words).difference(cache)
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = set(words)
        for w in new:
            cache[w] = self.look_up(w.lower())
        return [(i, *h) for i, w in enumerate(words) if (h := cache[w])], words

    def features(self, text: str | None, seen: tuple | None = None) -> list[float]:
        """What a score rests on: direct, misspelled and quoted hits, hits per 100 words, terms' weights, different words."""
        found, words = seen or (self.hits(text) if text else ([], []))
        if not found:
            return [0.0] * 10
        quoted = set()
        quotes = quotations(text)
        spans = [m.span() for m in WORD.finditer(text)] if quotes else []
        for i, _, _ in found:
            reported = any(w.lower() in REPORTS for w in words[max(0, i - CONTEXT) : i])
            if not reported and quotes:
                start, end = spans[i]
                k = bisect.bisect_left(quotes, (start,)) - 1
                reported = k >= 0 and 0 <= quotes[k][1] - end < NEAR_MARK
            if reported:
                quoted.add(i)
        direct = sum(1 for i, e, _ in found if e == 0 and i not in quoted)
        near = sum(1 for i, e, _ in found if e > 0 and i not in quoted)
        weigh = lambda terms: min(3.0, sum(self.odds[t] for t in terms) / 10) if self.odds else 0.0
        exact = {t for i, e, t in found if e == 0 and i not in quoted}
        different = {words[i].lower() for i, e, _ in found if e == 0}
        return [
            float(direct > 0), np.log1p(direct), float(near > 0), np.log1p(near), np.log1p(len(quoted)), np.log1p(100 * direct / len(words)),
            np.log1p(100 * near / len(words)), weigh(exact), weigh({t for i, e, t in found if e > 0 and i not in quoted} - exact), np.log1p(len(different))]

    def score(self, text: str | None, seen: tuple | None = None) -> float:
        if self.weights is None:
            return 0.0
        z = self.weights[0] + float(np.dot(self.weights[1:], self.features(text, seen)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def quotations(text: str) -> list[tuple[int, int]]:
    """(opening mark, closing mark) of each quotation: a mark opens after a space and before none, else it closes what is
    open. A mark without its partner changes nothing after the next opening one."""
    spans, open_ = [], -1
    for m in QUOTES.finditer(text):
        at = m.start()
        before, after = text[at - 1 : at] if at else "", text[at + 1 : at + 2]
        if (not before or before.isspace() or before in "([{-") and after and not after.isspace():
            open_ = at
        elif open_ >= 0:
            spans.append((open_, at))
            open_ = -1
    return spans


def terms_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def choose(doc_terms: list[set[str]], precise: set[str]) -> list[str]:
    """Greedy cover of the toxic documents: the term that adds most documents first, while it adds MIN_DOCS."""
    holds = defaultdict(set)
    for d, terms in enumerate(doc_terms):
        for t in terms & precise:
            holds[t].add(d)
    # among equals: whole words before stems, longer before shorter
    order = sorted(holds, key=lambda t: (-len(holds[t]), t.endswith("*"), -len(t), t))
    place = {t: k for k, t in enumerate(order)}
    words = sorted(t for t in holds if not t.endswith("*"))
    chosen, seen, prefixes, covers = [], Counter(), set(), defaultdict(list)

    def gone(t: str) -> bool:
        """Whether t has a chosen stem, or is only in documents of a chosen term."""
        stem = t.rstrip("*")
        return any(stem[:k] in prefixes for k in range(1, len(stem) + 1)) or any(holds[t] <= c for c in covers[next(iter(holds[t]))])

    # gains only fall, so a term whose gain is still the one it was queued with is the best of all
    queue = [(-len(holds[t]), k) for k, t in enumerate(order) if len(holds[t]) >= MIN_DOCS]
    heapq.heapify(queue)
    while queue:
        queued, k = heapq.heappop(queue)
        best = order[k]
        if gone(best):
            continue
        # documents count until three chosen terms hold them, so that terms that come together are all found
        gain = sum(1 for d in holds[best] if seen[d] < 3)
        if gain < -queued:
            if gain >= MIN_DOCS:
                heapq.heappush(queue, (-gain, k))
            continue
        word = best
        if best.endswith("*"):  # the whole word if it does the stem's work
            at, whole = bisect.bisect_left(words, best[:-1]), []
            while at < len(words) and words[at].startswith(best[:-1]):
                if len(holds[words[at]]) >= 0.9 * len(holds[best]) and not gone(words[at]):
                    whole.append(words[at])
                at += 1
            word = min(whole, key=place.get, default=best)
        chosen.append(word)
        for d in holds[best]:
            seen[d] += 1
            covers[d].append(holds[best])
        if word.endswith("*"):
            prefixes.add(word[:-1])
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Newton steps; the first weight is the constant."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + l2 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) / len(x) + l2 * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic): rows to learn from."""
    marked = labels.filter(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model([])
    share = F.when(F.col("toxic") == 1, min(1.0, max_docs / sizes[1])).otherwise(min(1.0, max_docs / sizes[0]))
    marked = marked.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < share * (1 << 20))
    # two thirds find the lexicon, one third the weights
    lexical = F.pmod(F.xxhash64("label_id", F.lit(7)), F.lit(3)) > 0
    train = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(marked), F.col("doc_id") == F.col("label_id"))
    toxic = train.filter(lexical & (F.col("toxic") == 1)).select("text")

    def run(batch: pa.RecordBatch) -> dict:
        found = [sorted(terms_of(t)) if t else [] for t in batch.column(0).to_pylist()]
        return {"terms": pa.array(found, pa.list_(pa.string()))}

    # candidates: terms of at least MIN_DOCS toxic documents of the bounded sample, then their clean documents
    per_doc = map_arrow(toxic, run, "terms array<string>")
    common = per_doc.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCS)
    top = {r.term: r.n for r in common.collect()}  # bounded as the sample is
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(top))

    def clean(batch: pa.RecordBatch) -> dict:
        n = Counter(t for x in batch.column(0).to_pylist() if x for t in terms_of(x) & sent.value)
        return {"term": list(n), "n": list(n.values())}

    in_clean = map_arrow(train.filter(lexical & (F.col("toxic") == 0)).select("text"), clean, "term string, n long", rows=20_000)
    against = {r.term: r.n for r in in_clean.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    rate = min(max_docs, sizes[0]) / min(max_docs, sizes[1])
    odds = {t: (n + 0.5) / (against.get(t, 0) + 0.5) * rate for t, n in top.items()}
    precise = {t for t, x in odds.items() if x >= MIN_ODDS}
    keep = docs.sparkSession.sparkContext.broadcast(frozenset(precise))

    def narrow(batch: pa.RecordBatch) -> dict:
        return {"terms": pa.array([sorted(terms_of(t) & keep.value) if t else [] for t in batch.column(0).to_pylist()], pa.list_(pa.string()))}

    held = [set(r.terms) for r in map_arrow(toxic, narrow, "terms array<string>").collect()]  # at most about max_docs rows
    terms = choose(held, precise)
    model = Model(terms, [float(np.log(odds[t])) for t in terms])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batch: pa.RecordBatch) -> dict:
        return {"x": pa.array([shared.value.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), "y": batch.column(1)}

    rows = map_arrow(train.filter(~lexical).select("text", "toxic"), measure, "x array<double>, y int").collect()
    y = np.array([r.y for r in rows], float)
    if len(rows) and 0 < y.sum() < len(y):
        model.weights = logistic(np.array([r.x for r in rows]), y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_hits, terms): n_hits and the distinct terms show what the score rests on."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        m, texts = sent.value, batch.column(1).to_pylist()
        seen = [m.hits(t) if t else ([], []) for t in texts]
        return {
            "doc_id": batch.column(0),
            "score": [m.score(t, x) for t, x in zip(texts, seen)],
            "n_hits": [len(f) for f, _ in seen],
            "terms": pa.array([sorted({m.terms[t] for _, _, t in f}) for f, _ in seen], pa.list_(pa.string())),
        }

    return map_arrow(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {kind}, score double, n_hits long, terms array<string>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    out = score(docs, model)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_hits", F.array_join("terms", ",").alias("terms"),
    )
