"""Operator 4: embedding near-duplicates by product quantisation.

Equal vectors are one class, so copies in any number are compared once. On at most about SAMPLE vectors are fitted: the
coarse centroids (above MAX_LISTS lists a second level of them on what the first leaves) and the codebooks of SUBSPACES
residual subspaces. Every vector goes into the inverted list of its nearest centroid with its code and the length of what
the code leaves out. It probes each list whose border with its own is nearer than ``reach``, half the way that a linked
vector may lie across a border; a pair is found where either side probes the other's list, so their halves add up. Table
lookups give approximate cosines; pairs whose approximation is within the code's own error of the threshold are compared
exactly, in double precision.

Dense lists: vectors within half the threshold's angle of their list's centroid are its core; any two of a core are linked,
and so are the cores of two lists whose angles allow no other result. Such pairs are counted, not compared, so a group of
near copies that holds a large part of all vectors costs no more than others. At most DENSE cores are told apart;
vectors of further ones are compared like others.

Lists are cut into blocks of about BLOCK vectors on both sides, so that none is gathered in one task; a block returns
link counts and a spanning forest of its links, never the pairs.

Cases: null vectors, empty or zero ones and those with null or non-finite components link with nothing; vectors of
different lengths don't link; each input row gives a row, rows with equal vectors link with each other (repeated rows
too); ids may be null, the smallest id that is not null names a component; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import components, labelled, saved, table, tidy

COSINE = 0.9
SAMPLE = 20_000
#: vectors that a list holds on average, and the most centroids of a level
PER_LIST, MAX_LISTS = 512, 1024
SUBSPACES, CODEWORDS = 8, 256
#: standard deviations of the step between linked vectors, along a border's normal, that both reaches together cover
SIGMAS = 2.5
BLOCK = 2048
#: least vectors of a core, most cores
CORE, DENSE = 32, 1024
#: up to so many lists their sizes are broadcast
SMALL = 100_000
CLOSE = 1e-6


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    c2 = (c * c).sum(1)[None, :]
    return np.concatenate([np.empty(0, np.int64), *[(c2 - 2 * x[a : a + 4096] @ c.T).argmin(1) for a in range(0, len(x), 4096)]])


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Level:
    """Centroids; which of them a vector probes."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.c2 = (centroids * centroids).sum(1)
        self.gaps = np.sqrt(np.maximum(self.c2[:, None] + self.c2[None, :] - 2 * centroids @ centroids.T, 1e-18))

    def probes(self, x: np.ndarray, reach: float) -> np.ndarray:
        """Rows x centroids: whether the border with the nearest centroid's cell is within reach."""
        d2 = self.c2[None, :] - 2 * x @ self.c.T
        home = d2.argmin(1)
        return (d2 - d2[np.arange(len(x)), home][:, None]) <= 2 * reach * self.gaps[home]


class Quantizer:
    """Coarse centroids of one or two levels and residual codebooks, for vectors of one length."""

    def __init__(self, x: np.ndarray, lists: int, cosine: float = COSINE):
        first = kmeans(x, min(lists, MAX_LISTS))
        res = x - first[nearest(x, first)]
        second = kmeans(res, min(-(-lists // len(first)), MAX_LISTS)) if lists > MAX_LISTS else np.zeros((1, x.shape[1]))
        self.levels, self.fan = (Level(first), Level(second)), len(second)
        res = res - second[nearest(res, second)]
        self.cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
        self.books = [kmeans(res[:, a:b], CODEWORDS) for a, b in zip(self.cuts, self.cuts[1:])]
        # a step between linked vectors spreads over the directions in which the vectors themselves vary
        spread = np.linalg.eigvalsh(np.cov(x.T).reshape(x.shape[1], -1)) if len(x) > 1 else np.ones(1)
        dims = max(1.0, float(spread.sum() ** 2 / max((spread**2).sum(), 1e-30)))
        self.reach = 0.5 * SIGMAS * np.sqrt((2 - 2 * cosine) / dims)

    def centroid(self, cell):
        return self.levels[0].c[cell // self.fan] + self.levels[1].c[cell % self.fan]

    def home(self, x: np.ndarray) -> np.ndarray:
        a = nearest(x, self.levels[0].c)
        return a * self.fan + nearest(x - self.levels[0].c[a], self.levels[1].c)

    def probed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that the vectors probe, their own ones included."""
        row, a = np.nonzero(self.levels[0].probes(x, self.reach))
        if self.fan == 1:
            return row, a
        rows, cells = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(row), 4096):
            r, c = row[at : at + 4096], a[at : at + 4096]
            k, b = np.nonzero(self.levels[1].probes(x[r] - self.levels[0].c[c], self.reach))
            rows.append(r[k])
            cells.append(c[k] * self.fan + b)
        return np.concatenate(rows), np.concatenate(cells)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code and error length of each vector."""
        res = x - self.centroid(home)
        code = np.empty((len(x), len(self.books)), np.uint8)
        for m, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            code[:, m] = nearest(res[:, a:b], book)
            res[:, a:b] -= book[code[:, m]]
        return code, np.sqrt((res * res).sum(1))

    def approximate(self, q: np.ndarray, cell: int, code: np.ndarray) -> np.ndarray:
        """Queries times codes: sums of looked-up partial products, in single precision."""
        out = np.repeat((q @ self.centroid(cell)).astype(np.float32)[:, None], len(code), 1)
        for m, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            out += (q[:, a:b] @ book.T).astype(np.float32).take(code[:, m], axis=1)
        return out


class Cores:
    """The dense lists' cores; ``sure[a, b]``: any vectors of the cores a and b are linked."""

    def __init__(self, rows: list, models: dict[int, Quantizer], cosine: float):
        self.at = {(r.dim, r.cell): k for k, r in enumerate(rows)}
        self.rep = np.array([r.rep for r in rows], np.int64)
        wide = np.arccos(np.clip([r.least for r in rows], -1, 1))
        self.sure = np.zeros((len(rows), len(rows)), bool)
        for dim in {r.dim for r in rows}:
            k = np.array([i for i, r in enumerate(rows) if r.dim == dim])
            c = models[dim].centroid(np.array([rows[i].cell for i in k]))
            c /= np.linalg.norm(c, axis=1)[:, None]
            angle = np.arccos(np.clip(c @ c.T, -1, 1))
            np.fill_diagonal(angle, 0)
            self.sure[np.ix_(k, k)] = angle + wide[k][:, None] + wide[k][None, :] <= np.arccos(cosine) - CLOSE
        np.fill_diagonal(self.sure, True)
        self.total = self.sure @ np.array([r.copies for r in rows], np.int64)

    def edges(self) -> list[tuple[int, int]]:
        """The representatives of cores that are linked for sure, as a forest."""
        row = np.arange(len(self.rep))
        while True:
            new = np.array([row[s].min() for s in self.sure], np.int64) if len(row) else row
            if (new == row).all():
                return [(int(a), int(self.rep[k])) for a, k in zip(self.rep, row) if a != self.rep[k]]
            row = new


def unit(vectors: list) -> np.ndarray:
    v = np.array(vectors, np.float64)
    v = v / np.abs(v).max(1)[:, None]
    return v / np.sqrt((v * v).sum(1))[:, None]


def forest(r: np.ndarray, c: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """For links (row r, column c): each row's and column's first row of its component, ``rows`` without links."""
    row, col = np.full(rows, rows), np.full(cols, rows)
    row[r] = r
    while True:
        np.minimum.at(col, c, row[r])
        new = row.copy()
        np.minimum.at(new, r, col[c])
        if (new == row).all():
            return row, col
        row = new


def by_length(batch: pa.RecordBatch, vec: int, dim: int, rows: int = 2000):
    """(length, indices, unit vectors) of slices of a batch."""
    dims = np.asarray(batch.column(dim))
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        for k in range(0, len(at), rows):
            part = at[k : k + rows]
            yield int(d), part, unit(batch.column(vec).take(pa.array(part)).to_pylist())


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    fine = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double"))
    ok = F.forall("v", fine) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"))
    rows = rows.select("vec_id", "v", F.when(F.coalesce(ok, F.lit(False)), F.xxhash64("v")).alias("cid"))
    classes = saved(
        rows.filter("cid is not null").groupBy("cid").agg(F.first("v").alias("v"), F.min("vec_id").alias("first"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("v")), "vectors")
    kind = classes.schema["v"].dataType.simpleString()
    dims = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row per length
    models = {}
    for dim, n in dims.items():
        part = classes.filter((F.col("dim") == dim) & (F.pmod("cid", F.lit(1 << 20)) < (1 << 20) * min(1.0, SAMPLE / n)))
        got = part.select("v").limit(2 * SAMPLE).toArrow().column(0)
        if not len(got):
            got = classes.filter(F.col("dim") == dim).select("v").limit(SAMPLE).toArrow().column(0)
        models[dim] = Quantizer(unit(got.to_pylist()), max(1, n // PER_LIST), cosine)
    sent = spark.sparkContext.broadcast(models)

    def settle(batches):
        for batch in batches:
            for dim, at, x in by_length(batch, 1, 3):
                home = sent.value[dim].home(x)
                c = sent.value[dim].centroid(home)
                to_home = np.einsum("ij,ij->i", x, c) / np.maximum(np.sqrt((c * c).sum(1)), 1e-30)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).take(pa.array(at)) for k in range(4)] + [pa.array(home, pa.int64()), pa.array(to_home, pa.float64())],
                    names=["cid", "v", "copies", "dim", "cell", "to_home"])

    settled = saved(classes.select("cid", "v", "copies", "dim").mapInArrow(tidy(settle), f"cid long, v {kind}, copies long, dim int, cell long, to_home double"), "homes")
    half = float(np.cos(np.arccos(cosine) / 2 - CLOSE))
    core = settled.filter(F.col("to_home") >= half).groupBy("dim", "cell").agg(
        F.count("*").alias("n"), F.sum("copies").alias("copies"), F.min("to_home").alias("least"), F.min("cid").alias("rep")).filter(F.col("n") >= CORE)
    cores = spark.sparkContext.broadcast(Cores(core.orderBy(F.desc("n"), "dim", "cell").limit(DENSE).collect(), models, cosine))

    def place(batches):
        for batch in batches:
            for dim, at, x in by_length(batch, 1, 3):
                model, dense = sent.value[dim], cores.value
                cid, copies, home, to_home = (np.asarray(batch.column(k))[at] for k in (0, 2, 4, 5))
                code, err = model.encode(x, home)
                row, cell = model.probed(x)
                core_of = lambda cells: np.array([dense.at.get((dim, c), -1) for c in cells.tolist()], np.int64)
                mine = np.where(to_home >= half, core_of(home), -1)
                # a list is two parts, the core and the rest; a part that needs no comparing is not probed
                theirs = core_of(cell)
                ask = theirs >= 0
                both = ask & (mine[row] >= 0)
                ask[both] = ~dense.sure[mine[row[both]], theirs[both]]
                row, cell, part = np.concatenate([row, row[ask]]), np.concatenate([cell, cell[ask]]), np.concatenate([np.zeros(len(row), np.int8), np.ones(ask.sum(), np.int8)])
                own = (cell == home[row]) & (part == (mine[row] >= 0))  # asked by the item's own row
                asks_own = np.zeros(len(x), bool)
                asks_own[row[own]] = True
                order = np.argsort(row, kind="stable")
                lists = np.split(cell[order], np.searchsorted(row[order], np.arange(1, len(x))))
                probes = [np.unique(p) for p in lists]
                row, cell, part = row[~own], cell[~own], part[~own]
                raw, n, m = [v.tobytes() for v in x], len(x), len(row)
                sure = np.where(mine >= 0, dense.total[mine] - copies, 0) if len(dense.rep) else np.zeros(n, np.int64)
                rep = np.where(mine >= 0, dense.rep[mine], cid) if len(dense.rep) else cid
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n + m, dim), pa.int32()), pa.array(np.concatenate([home, cell]), pa.int64()), pa.array(np.concatenate([mine >= 0, part]).astype(np.int32)),
                    pa.array([True] * n + [False] * m), pa.array(np.concatenate([asks_own, np.ones(m, bool)])), pa.array(np.concatenate([cid, cid[row]])),
                    pa.array(np.concatenate([copies, copies[row]])), pa.array(np.concatenate([home, home[row]]), pa.int64()), pa.array(raw + [raw[i] for i in row], pa.binary()),
                    pa.array([c.tobytes() for c in code] + [None] * m, pa.binary()), pa.array(np.concatenate([err, np.zeros(m)])),
                    pa.array([p.tobytes() for p in probes] + [None] * m, pa.binary()), pa.array(np.concatenate([sure, np.zeros(m, np.int64)])), pa.array(np.concatenate([rep, cid[row]])),
                ], names=["dim", "cell", "part", "item", "query", "cid", "copies", "home", "x", "code", "err", "probes", "sure", "rep"])

    placed = saved(settled.mapInArrow(tidy(place), "dim int, cell long, part int, item boolean, query boolean, cid long, copies long, home long, x binary, code binary, err double, probes binary, sure long, rep long"), "lists")
    # a part is cut by its own sizes: items to one of ni blocks and all of nq, queries the other way round
    size = placed.groupBy("dim", "cell", "part").agg(F.count_if("item").alias("items"), F.count_if("query").alias("queries")).filter("items > 0 and queries > 0")
    size = size.select("dim", "cell", "part", F.ceil(F.col("items") / BLOCK).cast("int").alias("ni"), F.ceil(F.col("queries") / BLOCK).cast("int").alias("nq"))
    lists = sum(max(1, n // PER_LIST) for n in dims.values())
    cut = placed.drop("sure", "rep").join(F.broadcast(size) if lists <= SMALL else size, ["dim", "cell", "part"])
    own = lambda n, seed: F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(n)).cast("int")
    cut = cut.withColumns({"own_i": F.when(F.col("item"), own("ni", 1)), "own_q": F.when(F.col("query"), own("nq", 2))})
    at = lambda i, q: F.struct(i.alias("bi"), q.alias("bq"))
    as_item = F.when(F.col("item"), F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda q: at(F.col("own_i"), q))).otherwise(F.array())
    as_query = F.when(F.col("query"), F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda i: at(i, F.col("own_q")))).otherwise(F.array())
    dealt = cut.withColumn("at", F.explode(F.array_union(as_item, as_query))).select("*", "at.bi", "at.bq").drop("at", "ni", "nq")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, cell = int(pdf["dim"].iloc[0]), int(pdf["cell"].iloc[0])
        model, q, i = sent.value[dim], pdf[pdf["own_q"] == pdf["bq"]], pdf[pdf["own_i"] == pdf["bi"]]
        frames = [pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "int64", "n": "int64"})]
        if not len(q) or not len(i):
            return frames[0]
        ids, copies = i["cid"].to_numpy(), i["copies"].to_numpy()
        x = np.frombuffer(b"".join(i["x"]), np.float64).reshape(len(i), dim)
        code = np.frombuffer(b"".join(i["code"]), np.uint8).reshape(len(i), -1)
        low = (cosine - i["err"].to_numpy() - 1e-4).astype(np.float32)
        # the lists that the items probe, as pairs (item, list)
        counts = np.array([len(p) // 8 for p in i["probes"]])
        back = set_of(np.repeat(np.arange(len(i)), counts), np.frombuffer(b"".join(i["probes"]), np.int64))
        for k in range(0, len(q), BLOCK):
            mine = q.iloc[k : k + BLOCK]
            me, my, home = mine["cid"].to_numpy(), mine["copies"].to_numpy(), mine["home"].to_numpy()
            y = np.frombuffer(b"".join(mine["x"]), np.float64).reshape(len(mine), dim)
            r, c = np.nonzero(model.approximate(y, cell, code) >= low[None, :])
            other = me[r] != ids[c]
            r, c = r[other], c[other]
            near = np.concatenate([np.einsum("ij,ij->i", y[r[j : j + 50_000]], x[c[j : j + 50_000]]) >= cosine for j in range(0, max(len(r), 1), 50_000)])
            r, c = r[near], c[near]
            if not len(r):
                continue
            n = np.bincount(r, weights=copies[c], minlength=len(me)).astype(np.int64)
            # the item counts the link itself where it probes the query's list
            lone = ~back(c, home[r])
            m = np.bincount(c[lone], weights=my[r[lone]], minlength=len(ids)).astype(np.int64)
            row, col = forest(r, c, len(me), len(ids))
            nodes, roots = np.concatenate([me, ids]), np.concatenate([row, col])
            has = roots < len(me)
            a = np.concatenate([me[n > 0], ids[m > 0], nodes[has]])
            b = np.concatenate([me[n > 0], ids[m > 0], me[roots[has]]])
            frames.append(pd.DataFrame({"a": a, "b": b, "n": np.concatenate([n[n > 0], m[m > 0], np.zeros(has.sum(), np.int64)])}))
        return pd.concat(frames, ignore_index=True)

    got = saved(dealt.groupBy("dim", "cell", "part", "bi", "bq").applyInPandas(block, "a long, b long, n long"), "blocks")
    sure = placed.filter("item and sure > 0")
    links = got.select(F.col("a").alias("node"), "n").union(sure.select("cid", "sure")).groupBy("node").agg(F.sum("n").alias("n"))
    edges = got.select("a", "b").union(placed.filter("item").select("cid", "rep")).union(spark.createDataFrame(cores.value.edges(), "a long, b long"))
    roots = components(edges.filter(F.col("a") != F.col("b")).distinct())
    known = classes.select("cid", "first", "copies").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = known.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component"))
    label = labelled(known, "root", smallest, "r").join(links.withColumnRenamed("node", "cid"), "cid", "left")
    label = saved(label.select("cid", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector_labels")
    out = labelled(rows.drop("v"), "cid", label.withColumnRenamed("cid", "key"), "key").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def set_of(a: np.ndarray, b: np.ndarray):
    """Membership in the pairs (a, b), as a function of arrays."""
    width = int(b.max()) + 1 if len(b) else 1
    keys = np.unique(a.astype(np.int64) * width + b)

    def has(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = x.astype(np.int64) * width + y
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return (y < width) & (keys[at] == k) if len(keys) else np.zeros(len(x), bool)

    return has


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
