"""Operator 13: tokens of two tokenizers aligned by the bytes they stand for.

A is a byte-level tokenizer of the tokenizers library, which gives character offsets; B is a sentencepiece model, whose
proto gives the byte span of each piece. Offsets and spans are the coarse cuts; where several tokens share a character
(parts of a multibyte character, byte-fallback pieces) the cuts between them come from the tokens' decoded bytes. Cuts
that both have make groups; an A and a B token are linked where their ranges overlap.

Neither tokenizer has a token that goes on over a single space between two other characters (this is looked up in both
vocabularies), so texts are cut there and each different part is aligned once while it is cached; parts are put together
from lines and from words and the mark after them where the vocabularies allow that too. How many documents hold
a pair of ids is counted by Spark over the documents' different pairs; the counts go back to the documents by a join,
broadcast if the table of pairs has at most BROADCAST_PAIRS rows, else shuffled by pair.

Cases: null and empty texts, and texts whose tokens of either side do not give back space and text, have no tokens; rows
that repeat a doc_id are documents of their own; a null doc_id stays null; an empty table gives no rows. Columns other
than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import map_arrow, saved, table
from lotwise.llm.records import byte_letters

#: entries of a worker's cache of parts, some 600 bytes each; it starts anew when full
CACHE = 600_000
#: the table of id pairs is broadcast up to so many rows (some 80 MB); beyond it the join shuffles by pair
BROADCAST_PAIRS = 2_000_000
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
OTHER_SPACE = re.compile(r"[^\S \n]")
LINES = re.compile(r"(?<=\S)(?=\n\S)")
OVER_SPACE = re.compile(r"\S ")
#: new parts that are aligned together
PARTS = 5_000


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def size_of(key: str | tuple[str]) -> int:
    return len(key[0] if type(key) is tuple else key)


class Aligner:
    def __init__(self, a_file: str, b_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use the cores
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_file)
        odd = byte_letters()
        letter = {odd.get(b, chr(b)): b for b in range(256)}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.a_bytes[k] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size()))]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.parted = not any(OVER_SPACE.search(x.decode(errors="replace")) for x in (*self.a_bytes, *self.b_bytes))
        self.lined = not any(b"\n" in x[1:] or b"\n" in x[:-1] for x in self.b_bytes)
        self.marks = {}
        pieces = [x.decode(errors="replace") for x in self.b_bytes]
        if not any(a.isalpha() and b in ".,;:!?" for p in pieces for a, b in zip(p, p[1:])):
            for m in ".,;:!?":
                a, b = vocab[m], self.b.piece_to_id(m)
                if self.b_bytes[b] == m.encode():
                    self.marks[m] = (np.array([1, 1, 1], "<u4").tobytes(), np.array([a << 32 | b], "<i8").tobytes(), f"{a}|{b};".encode())
        n = max(len(self.a_bytes), len(self.b_bytes))
        #: ids as text with what follows them: another token, the other side, another group
        self.said = np.array([[f"{k}{end}".encode() for k in range(n)] for end in ",|;"], object)
        self.same: dict[bytes, bytes] = {}  # counts, of which there are few
        #: by part, and by (later line,)
        self.cache: dict[str | tuple[str], tuple[bytes, bytes, bytes] | None] = {}

    def parts(self, text: str) -> list[str]:
        """Parts of a text that are tokenised independently; each stands for a space and itself."""
        if not self.parted:
            return [text]
        if len(text.split()) == text.count(" ") + text.count("\n") + 1 and not OTHER_SPACE.search(text):
            return text.split(" ")
        return BETWEEN.split(text)

    def units(self, part: str) -> list[tuple[str | tuple[str], str]]:
        """The lines of a part, each as (what to align, mark after its last letter); a later line begins with its newline
        and is a tuple."""
        if "\n" not in part or not self.lined:
            return [(part[:-1], part[-1]) if part[-1:] in self.marks and part[-2:-1].isalpha() else (part, "")]
        cut = [(q[:-1], q[-1]) if q[-1:] in self.marks and q[-2:-1].isalpha() else (q, "") for q in LINES.split(part)]
        return [*cut[:1], *(((q,), mark) for q, mark in cut[1:])]

    def align(self, keys: list[str | tuple[str]]) -> None:
        """Puts (counts of A, B and groups; linked pairs; groups as text) of each key in the cache; None where tokens of
        either side do not give back its text. A part stands for a space and itself, a later line for itself."""
        later = [type(k) is tuple for k in keys]
        parts = [k[0] if x else k for k, x in zip(keys, later)]
        spaced = [p if x else " " + p for p, x in zip(parts, later)]
        a_ids, a_coarse, a_n, b_ids, b_coarse, b_n = [], [], [], [], [], []
        for e in self.a.encode_batch(spaced, add_special_tokens=False):
            ids = e.ids
            a_ids += ids
            a_coarse += [end for _, end in e.offsets]
            a_n.append(len(ids))
        for m, skip in zip(self.b.encode(parts, return_type="proto", num_threads=1), later):
            before = len(b_ids)
            for p in m.pieces[1:] if skip else m.pieces:  # the space that B adds stands alone before a newline
                b_ids.append(p.id)
                b_coarse.append(p.end)
            b_n.append(len(b_ids) - before)
        raw = [s.encode() for s in spaced]
        whole = np.frombuffer(b"".join(raw), np.uint8)
        starts_char = np.append((whole & 0xC0) != 0x80, True)
        char_at = np.flatnonzero(starts_char)  # where each character starts, and the end
        byte_at, char_no = offsets([len(r) for r in raw]), offsets([len(s) for s in spaced])
        added = 1 - np.array(later, np.int64)
        ok = np.ones(len(parts), bool)
        sides = []
        for ids, coarse, n, length, tokens in ((a_ids, a_coarse, a_n, self.a_len, self.a_bytes), (b_ids, b_coarse, b_n, self.b_len, self.b_bytes)):
            ids, coarse, n = np.array(ids, np.int64), np.array(coarse, np.int64), np.array(n, np.int64)
            part = np.repeat(np.arange(len(parts)), n)
            # coarse cuts as positions in all bytes: characters of A, bytes of B without the space it adds
            coarse = char_at[char_no[part] + coarse] if tokens is self.a_bytes else byte_at[part] + added[part] + coarse
            run = np.cumsum(length[ids])
            first = offsets(n)
            decoded = run - offsets(length[ids])[first[part]] + byte_at[part]
            inside = ~starts_char[np.minimum(decoded, len(whole))]
            end = np.where(inside, decoded, coarse)
            good = np.bincount(part, weights=end != decoded, minlength=len(parts)) == 0
            good &= np.bincount(part, weights=length[ids], minlength=len(parts)) == np.diff(byte_at)
            if not good.all() or b"".join(map(tokens.__getitem__, ids.tolist())) != whole.tobytes():
                good &= np.array([b"".join(map(tokens.__getitem__, ids[s:e].tolist())) == r for s, e, r in zip(first[:-1], first[1:], raw)], bool)
            ok &= good
            sides.append((ids, end, part, length))
        (a, a_end, a_part, a_len), (b, b_end, b_part, b_len) = ((ids[k], end[k], part[k], length[ids[k]]) for ids, end, part, length in sides for k in [ok[part]])
        lo, hi = np.searchsorted(b_end, a_end - a_len, "right"), np.searchsorted(b_end - b_len, a_end, "left")
        n_links = hi - lo
        other = np.arange(n_links.sum()) - np.repeat(offsets(n_links)[:-1], n_links) + np.repeat(lo, n_links)
        pairs = (np.repeat(a, n_links) << 32 | b[other]).astype("<i8").tobytes()
        cuts = a_end[b_end[np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)] == a_end] if len(b_end) else a_end
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        last = [np.append(g[1:] != g[:-1], True)[: len(g)] for g in (a_group, b_group)]
        said = np.concatenate([self.said[np.where(last[0], 1, 0), a], self.said[np.where(last[1], 2, 0), b]])
        said = said[np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")].tolist()
        size = len(parts)
        count = np.stack([np.bincount(a_part, minlength=size), np.bincount(b_part, minlength=size), np.bincount(b_part[last[1]], minlength=size)], 1)
        link_at = (8 * offsets(np.bincount(a_part, weights=n_links, minlength=size).astype(np.int64))).tolist()
        said_at, packed = offsets(count[:, 0] + count[:, 1]).tolist(), [self.same.setdefault(x, x) for x in map(bytes, count.astype("<u4").view("V12").ravel())]
        for k, (p, fine) in enumerate(zip(keys, ok.tolist())):
            self.cache[p] = (packed[k], pairs[link_at[k] : link_at[k + 1]], b"".join(said[said_at[k] : said_at[k + 1]])) if fine else None

    def batch(self, texts: list[str | None]) -> list[tuple | None]:
        """(counts of A, B and groups; all linked pairs; groups as text) of each text, None where it has no tokens."""
        split = [self.parts(t) if t else [] for t in texts]
        wanted = set().union(*split)
        missing = wanted.difference(self.cache)
        if len(self.cache) + len(missing) > CACHE:
            self.cache.clear()
            missing = wanted
        made = {p: self.units(p) for p in missing}
        # the shortest first: a few very long parts do not meet many others
        new = sorted({q for units in made.values() for q, _ in units}.difference(self.cache), key=size_of)
        at = 0
        while at < len(new):
            size = max(1, min(PARTS, 2_000_000 // (size_of(new[min(at + PARTS, len(new)) - 1]) + 1)))
            self.align(new[at : at + size])
            at += size
        for p, units in made.items():
            if len(units) > 1 or units[0][1]:
                got = [x for q, mark in units for x in ((self.cache[q], self.marks[mark]) if mark else (self.cache[q],))]
                self.cache[p] = None if None in got else tuple(map(b"".join, zip(*got)))
        out = []
        for s in split:
            got = [self.cache[p] for p in s]
            if not got or None in got:
                out.append(None)
                continue
            counts, pairs, groups = zip(*got)
            out.append((np.frombuffer(b"".join(counts), "<u4").reshape(-1, 3).sum(0, dtype=np.int64), np.frombuffer(b"".join(pairs), "<i8"), b"".join(groups)[:-1]))
        return out


@lru_cache(maxsize=2)
def aligner(a_file: str, b_file: str) -> Aligner:
    return Aligner(a_file, b_file)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(docs: DataFrame, files: tuple[str, str] | None = None, groups: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): a document's different linked id pairs, as
    A's id times 2^32 plus B's, with how often it has each. ``row`` numbers the rows within one evaluation. With
    ``groups`` also the groups as text, `a1,a2|b1;a3|b2,b3`."""
    a_file, b_file = files or default_files()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        n, hashes, said, pairs, times = np.zeros((batch.num_rows, 4), np.int64), [], [], [], []
        for k, got in enumerate(aligner(a_file, b_file).batch(batch.column(2).to_pylist())):
            hashes.append("" if got is None else hashlib.sha256(got[2]).hexdigest())
            said.append("" if got is None or not groups else got[2].decode())
            if got is not None:
                n[k] = *got[0], len(got[1])
            found = np.unique(got[1], return_counts=True) if got is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            pairs.append(found[0])
            times.append(found[1].astype(np.int32))
        at = pa.array(offsets([len(p) for p in pairs]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x), t)) for x, t in ((pairs, pa.int64()), (times, pa.int32()))]
        cols = {"row": batch.column(0), "doc_id": batch.column(1), "groups_sha256": hashes, "pairs": lists[0], "times": lists[1], "groups": said}
        return cols | {name: pa.array(n[:, i]) for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))}

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string"))
    schema = f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<int>" + ", groups string" * groups
    return map_arrow(rows, run, schema, rows=200)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best): documents that hold a pair, and whether no pair of its A id is held by more."""
    counts = saved(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pairs")
    a_id = F.shiftright("pair", 32)
    most = counts.groupBy(a_id.alias("a")).agg(F.max("docs").alias("most"))
    return counts.join(most, a_id == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame) -> DataFrame:
    """aligned with n_best, its links whose pair is the best of its A id, and count_sum, the sum of its links' counts."""
    counts = saved(pair_counts(aligned), "counts")
    side = F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts
    links = aligned.select("row", F.inline(F.arrays_zip("pairs", "times"))).join(side, F.col("pairs") == F.col("pair"))
    sums = links.groupBy(F.col("row").alias("_row")).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    joined = aligned.drop("pairs", "times").join(sums, F.col("row") == F.col("_row"), "left").drop("_row")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_counts(saved(align(table(spark, sf_dir, "documents")), "aligned"))
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
