"""Operator 5: byte-level BPE encoding and decoding.

Text is split by the tokenizer's pattern; each piece is merged over a segment tree on its byte positions. A leaf
holds the rank of the pair that starts there (the merged token's rank, tagged with its position), an inner node
the minimum of its children, so the root is the leftmost minimum-rank pair. A merge sets the leaf of the dead
right half to "none" and renews the leaves of the merged piece and its live left neighbour: three point updates of
logarithmic cost. Short pieces of a batch are merged together, one numpy row each; long pieces use a scalar tree.

Cases: null and empty texts give no ids; pieces that are a vocabulary entry are that id; any byte sequence encodes,
as all 256 single bytes are entries.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import map_arrow, table

#: no pair; above every rank times the widest row of positions
NONE = np.int32(2**31 - 1)
#: longest piece, in bytes, that is merged together with others
ROW = 64
OTHER_SPACE = re.compile(r"[^\S \n]")
#: entries of a task's cache of words; it starts anew when full and is let go when the task ends
CACHE = 250_000


def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BytePairEncoder:
    """ranks_file: lines of base64 token and rank; pattern: what splits text into pieces."""

    def __init__(self, ranks_file: str, pattern: str):
        import regex

        self.ranks = ranks = read_ranks(ranks_file)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # every way to make a token of two tokens, by the pair's key
        ways = np.array([(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks], np.int64)
        key = (ways[:, 0] << 32) | ways[:, 1]
        order = np.argsort(key)
        self.keys, self.vals = key[order], ways[order, 2].astype(np.int32)
        self.pairs: dict[int, int] = {}  # filled only where a long piece needs it
        # \s as Unicode's White_Space, which the rank file's reference implementation uses
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.cache: dict[str, bytes] = {}

    def release(self) -> None:
        """Lets go of what grew with the texts."""
        self.cache, self.pairs = {}, {}

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs, NONE where they make no token; ids below 0 stand for no token."""
        k = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.keys, k)
        at[at == len(self.keys)] = 0
        return np.where(self.keys.take(at) == k, self.vals.take(at), NONE)

    def merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of at most ``width`` bytes (a power of two), one tree per row of flat arrays.

        ids, nxt and prv have a place more than bytes in each row, which stands for "no token".
        """
        n, shift, step = len(pieces), width.bit_length() - 1, width + 1
        length = np.fromiter(map(len, pieces), np.int32, n)[:, None]
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        pos = np.arange(step, dtype=np.int32)
        ids = np.full((n, step), -1, np.int32)
        ids[:, :-1] = np.where(pos[:-1] < length, self.byte_id[raw], -1)
        nxt = np.where(pos + 1 < length, pos + 1, np.int32(width))
        prv = np.broadcast_to(pos - 1, (n, step)).copy()
        tree = np.full((n, 2 * width), NONE, np.int32)
        first = self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        tree[:, width:] = np.where((first < NONE) & (ids[:, 1:] >= 0), (first << shift) | pos[:-1], NONE)
        half = width // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        row = np.flatnonzero(tree[:, 1] < NONE)
        ids, nxt, prv, tree = ids.ravel(), nxt.ravel(), prv.ravel(), tree.ravel()
        while len(row):
            base, root = row * step, row * (2 * width)
            top = tree.take(root + 1)
            i, rank = top & (width - 1), top >> shift
            at = base + i
            j = nxt.take(at)
            k = nxt.take(base + j)
            h = prv.take(at)
            ids[at], ids[base + j], nxt[at] = rank, -1, k
            prv[base + k] = i
            # the merged piece with its right neighbour, the left neighbour with the merged piece
            ranks = self.pair_rank(np.concatenate([rank, ids.take(base + h)]), np.concatenate([ids.take(base + k), rank]))
            none, m = h < 0, len(row)
            h = np.where(none, j, h)
            leaf = np.concatenate([j, i, h])
            value = np.concatenate([np.full(m, NONE), ranks])
            value[m:] = np.where(ranks < NONE, (ranks << shift) | leaf[m:], NONE)
            value[2 * m :][none] = NONE
            roots = np.concatenate([root, root, root])
            node = leaf + np.int32(width)
            tree[roots + node] = value
            for _ in range(shift):  # the three paths to the root, level by level
                node >>= 1
                kid = roots + 2 * node
                tree[roots + node] = np.minimum(tree.take(kid), tree.take(kid + 1))
            row = row[tree.take(root + 1) < NONE]
        ids = ids.reshape(n, step)
        keep = ids >= 0
        flat = ids[keep].astype("<u4").tobytes()
        ends = (np.cumsum(keep.sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def merge_long(self, piece: bytes) -> bytes:
        """The same tree for one piece of any length."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), self.vals.tolist()))
        get, none = self.pairs.get, 1 << 62
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = get((ids[i] << 32) | ids[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for v in range(width - 1, 0, -1):
            tree[v] = min(tree[2 * v], tree[2 * v + 1])

        def put(i, value):
            v = i + width
            tree[v] = value
            while v > 1:
                v >>= 1
                low = min(tree[2 * v], tree[2 * v + 1])
                if tree[v] == low:
                    break
                tree[v] = low

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = nxt[i]
            k = nxt[j]
            ids[i], ids[j], nxt[i] = rank, -1, k
            put(j, none)
            r = None
            if k < n:
                prv[k] = i
                r = get((rank << 32) | ids[k])
            put(i, none if r is None else r * width + i)
            h = prv[i]
            if h >= 0:
                r = get((ids[h] << 32) | rank)
                put(h, none if r is None else r * width + h)
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def pieces_ids(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces, each a match of the pattern."""
        out, by_width = {}, {}
        for p in pieces:
            b = p.encode()
            r = self.ranks.get(b)
            if r is not None:
                out[p] = r.to_bytes(4, "little")
            elif len(b) > ROW:
                out[p] = self.merge_long(b)
            else:
                by_width.setdefault(max(4, 1 << (len(b) - 1).bit_length()), []).append((p, b))
        for width, group in by_width.items():
            for at in range(0, len(group), 10_000):
                part = group[at : at + 10_000]
                out.update(zip((p for p, _ in part), self.merge_rows([b for _, b in part], width)))
        return out

    def words(self, text: str) -> list[str]:
        """Keys of substrings that are split independently of each other: a single space between two other characters
        always starts a match. A key without a leading space is a word after a space, one with a leading space is
        what follows that space. Texts with other white space than single spaces and newlines are split in whole."""
        if len(text.split()) != text.count(" ") + text.count("\n") + 1 or OTHER_SPACE.search(text):
            return [p[1:] if p[0] == " " and len(p) > 1 and " " not in p[1:] else " " + p for p in self.pattern.findall(text)]
        keys = text.split(" ")
        keys[0] = " " + keys[0]
        return keys

    def pieces(self, key: str) -> str | list[str]:
        """The matches in a key's text, a single one by itself; plain words need no pattern."""
        chunk = key[1:] if key[0] == " " else " " + key
        if key.isalpha() and (key.isascii() or max(key) < "\u0250"):
            return chunk
        head = key[:-1]
        if key[-1] in ".,;:!?" and head.isalpha() and (head.isascii() or max(head) < "\u0250"):
            return [chunk[:-1], key[-1]]
        return self.pattern.findall(chunk)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.words(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.cache)
        if new:
            if len(self.cache) + len(new) > CACHE:
                self.cache = {}
                new = set().union(*split)
            found = [(w, self.pieces(w)) for w in new]
            several = [p for _, p in found if type(p) is list]
            ids = self.pieces_ids(list({p for _, p in found if type(p) is str}.union(*several)))
            self.cache.update([(w, ids[p] if type(p) is str else b"".join([ids[x] for x in p])) for w, p in found])
        get = self.cache.__getitem__
        return [b"".join(map(get, s)) for s in split]


@lru_cache(maxsize=4)
def encoder(ranks_file: str, pattern: str) -> BytePairEncoder:
    return BytePairEncoder(ranks_file, pattern)


@lru_cache(maxsize=4)
def token_table(ranks_file: str) -> list[bytes | None]:
    ranks = read_ranks(ranks_file)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        table[r] = t
    return table


def decode_batch(ids: list[bytes | None], ranks_file: str) -> list[bytes]:
    get = token_table(ranks_file).__getitem__
    return [b"".join(map(get, np.frombuffer(x, "<u4").tolist())) if x else b"" for x in ids]


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: tuple[str, str] | None = None, decoded: bool = False) -> DataFrame:
    """(id, ids): ids as binary, little-endian unsigned 32-bit integers; one row per input row, no shuffle.

    With ``decoded`` also the bytes that these ids stand for, as decode gives them, by the same worker.
    """
    file, pattern = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        ids = encoder(file, pattern).encode_batch(batch.column(1).to_pylist())
        out = {id_col: batch.column(0), "ids": pa.array(ids, pa.binary())}
        return out | {"decoded": pa.array(decode_batch(ids, file), pa.binary())} if decoded else out

    return map_arrow(docs.select(id_col, F.col(text_col).cast("string")), run, f"`{id_col}` {kind}, ids binary" + ", decoded binary" * decoded, rows=300, done=lambda: encoder(file, pattern).release())


def decode(encoded: DataFrame, id_col: str = "doc_id", tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """(id, ids, decoded): decoded is the bytes that the ids stand for; empty for null ids."""
    file, _ = tokenizer or default_tokenizer()
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        return {id_col: batch.column(0), "ids": batch.column(1), "decoded": pa.array(decode_batch(batch.column(1).to_pylist(), file), pa.binary())}

    return map_arrow(encoded.select(id_col, "ids"), run, f"`{id_col}` {kind}, ids binary, decoded binary")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(table(spark, sf_dir, "documents"), decoded=True)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
