"""Token alignment against a plain version that tokenises whole texts and compares all ranges."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from lotwise.llm import alignment
from tests.conftest import SF

A_FILE, B_FILE = alignment.default_files()
ALPHABET = "ab ,.\n\t  éß日本🎉▁<0x0A>\x1c\x85ﬁ½'sTHE١‍́　#12!?;:"


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    a.encode_special_tokens = True
    odd = [x for x in range(256) if x not in {*range(33, 127), *range(161, 173), *range(174, 256)}]
    letter = {chr(256 + odd.index(x)) if x in odd else chr(x): x for x in range(256)}
    a_bytes = {k: bytes(map(letter.get, t)) for t, k in a.get_vocab().items() if t != "<|endoftext|>"}

    def ranges(tokens):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    def one(text):
        if not text:
            return None
        raw = (" " + text).encode()
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ta = [a_bytes[k] for k in ia]
        tb = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ib)]
        if b"".join(ta) != raw or b"".join(tb) != raw:
            return None
        ra, rb = ranges(ta), ranges(tb)
        holder = {p: k for k, (s, e) in enumerate(rb) for p in range(s, e)}
        links = [(x, ib[k]) for x, (s, e) in zip(ia, ra) for k in sorted({holder[p] for p in range(s, e)})]
        cuts = sorted({e for _, e in ra} & {e for _, e in rb})
        number = {p: k for k, (low, high) in enumerate(zip([0, *cuts], cuts)) for p in range(low + 1, high + 1)}
        sides = [[[] for _ in cuts] for _ in "ab"]
        for ids, r, side in ((ia, ra, sides[0]), (ib, rb, sides[1])):
            for k, (_, e) in zip(ids, r):
                side[number[e]].append(str(k))
        return ia, ib, links, [",".join(x) + "|" + ",".join(y) for x, y in zip(*sides)]

    def rows(docs):
        found, held, best = [(d, one(t)) for d, t in docs], Counter(), defaultdict(int)
        for _, r in found:
            held.update(set(r[2]) if r else ())
        for (x, _), n in held.items():
            best[x] = max(best[x], n)
        return sorted(
            (d, len(r[0]), len(r[1]), len(r[3]), len(r[2]), sum(held[p] == best[p[0]] for p in r[2]), sum(held[p] for p in r[2]), hashlib.sha256(";".join(r[3]).encode()).hexdigest())
            if r else (d, 0, 0, 0, 0, 0, 0, "") for d, r in found)

    return one, rows


COLS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def result(spark, docs, schema="doc_id long, text string"):
    df = spark.createDataFrame(docs, schema)
    return sorted(tuple(r[c] for c in COLS) for r in alignment.with_counts(alignment.saved(alignment.align(df), "aligned")).collect())


def texts(seed, n, most=25):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, most))) for _ in range(n)]


def test_texts_of_odd_characters(plain):
    one, _ = plain
    al, some = alignment.Aligner(A_FILE, B_FILE), texts(3, 4000) + ["\nword. A b", "word.\nNext, one!\n\nx", "x .", " ,", "a\n ,b", "don't.\nstop 's", "²,", "word.. x"]
    assert al.parted and al.lined and len(al.marks) == 6
    for text, got in zip(some, al.batch(some)):
        want = one(text)
        if want is None:
            assert got is None, text
        else:
            assert tuple(got[0]) == (len(want[0]), len(want[1]), len(want[3])), text
            assert Counter(got[1].tolist()) == Counter(x << 32 | y for x, y in want[2]), text
            assert got[2].decode() == ";".join(want[3]), text


def test_query_equals_plain_version(spark, plain):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, alignment.op13_alignment(spark, SF).collect())) == plain[1]([(r.doc_id, r.text) for r in rows])


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_counts_with_and_without_broadcast(spark, plain, monkeypatch, most):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", most)
    docs = list(enumerate(texts(5, 300) + ["the same text here"] * 150))
    assert result(spark, docs) == plain[1](docs)


def test_odd_rows(spark, plain):
    docs = [(1, None), (2, ""), (3, " "), (4, "x" * 20_000), (5, "a b"), (5, "a b"), (6, "tie one"), (7, "<|endoftext|> <s> </s>"), (8, "a▁b")]
    assert result(spark, docs) == plain[1](docs)
    assert result(spark, []) == []
    more = spark.createDataFrame([(None, "a b", 1, [2])], "doc_id long, text string, row long, pairs array<int>")
    got = alignment.with_counts(alignment.saved(alignment.align(more), "aligned")).collect()
    assert got[0].doc_id is None and got[0].n_links == 2


def test_groups_as_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.align(df, groups=True).collect()}
    assert hashlib.sha256(got[1].groups.encode()).hexdigest() == got[1].groups_sha256 and got[2].groups == ""
