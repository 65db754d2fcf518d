"""Operators 4 and 9 against brute force."""

import random
import re

import numpy as np

from lotwise.llm import embeddings, jaccard
from lotwise.llm.common import components


def groups(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def documents():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    texts = [None, "", "  \t\n", "one two", "One  TWO", "one two three", "É a b c d", "é a b c d"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([6, 30, 80, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 8])):
            other = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n"]).join(other))
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.choice([3, 12, 25, 60]))) for _ in range(30)]
    return texts


def test_jaccard_equals_brute_force(spark):
    texts = documents()
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = groups(len(texts), links)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, token string, n int")
    got = {r.doc_id: r for r in jaccard.similar(docs).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want
    kept = {r.doc_id for r in jaccard.keep_one(docs).collect()}
    assert kept == {i for i, w in enumerate(want) if i == w}


def test_jaccard_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "A B C D E F"), (7, None), (7, None), (None, None)]
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 2, 1), (1, 2, 1), (1, 2, 1), (7, 0, 7), (7, 0, 7)]
    assert jaccard.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}


def test_embeddings_recall_and_precision(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(600, 24))
    base /= np.linalg.norm(base, axis=1)[:, None]
    near = []
    for x in base[:150]:
        for cosine in (0.905, 0.93, 0.97):
            d = rng.normal(size=24)
            d -= d @ x * x
            near.append(cosine * x + np.sqrt(1 - cosine**2) * d / np.linalg.norm(d))
    vecs = np.vstack([base, near, base[:5], 3 * base[5:10]]).astype(np.float32)
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vecs)] + [(10_000 + i, v, 1) for i, v in enumerate(odd)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, cid int")).collect()}
    assert len(got) == len(rows)
    x = vecs.astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= link.sum(1)).all()
    assert found.sum() >= 0.95 * link.sum()
    for i in range(6):
        assert (got[10_000 + i].n_links, got[10_000 + i].component_id, got[10_000 + i].kept) == (0, 10_000 + i, True)
    assert got[10_007].component_id == 10_006
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embeddings_odd_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, None), (2, None), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in embeddings.near_duplicates(odd).collect())
    assert got == [(0, 2, 3), (1, 0, 1), (1, 0, 1), (2, 0, 2), (2, 0, 2), (3, 2, 3), (3, 2, 3)]


def test_embeddings_dense_lists_equal_brute_force(spark):
    """A third of all vectors are near copies of one, which cores count without comparing."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1200, 16))
    one = rng.normal(size=16)
    copies = one / np.linalg.norm(one) + 0.02 * rng.normal(size=(600, 16))
    halo = one / np.linalg.norm(one) + 0.09 * rng.normal(size=(200, 16))
    v = np.vstack([base, copies, halo])
    x = v / np.linalg.norm(v, axis=1)[:, None]
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(rows).collect()}
    found = np.array([got[i].n_links for i in range(len(v))])
    assert (found <= link.sum(1)).all() and found.sum() >= 0.97 * link.sum()
    assert len({got[i].component_id for i in range(1200, 1800)}) == 1
