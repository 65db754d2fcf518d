"""The queries of matching that have no SQL twin against brute-force versions in plain Python, on the whole smallest tables."""

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from lotwise.functions import fuzzy
from lotwise.functions.stem import stem
from lotwise.functions.text import NAME_MAP, clean_title
from lotwise.operators import matching
from lotwise.plans import stores, texts
from lotwise.sources import views

ratio = lru_cache(maxsize=None)(fuzzy.weighted_ratio)


def tokens(text):
    return [t for t in re.findall(r"\w{2,}", (text or "").lower()) if t not in matching.STOPWORDS]


def mapped(text):
    for a, b in NAME_MAP:
        text = text.replace(a, b)
    return text


def plain(text):
    return " ".join(re.sub(r"[^a-z0-9\s]", "", (text or "").lower().replace("-", " ")).split())


def without(text, words):
    for w in words:
        text = (text or "").replace(w, "")
    return re.sub(r"\b\d{4}\b", "", re.sub(r"\s*\(.*?\)\s*$", "", text))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def allowed(r, c):
    """The standard rules of a request with its cleaned name and a catalogue row."""
    low = lambda x: (x or "").lower()
    if r.colour is not None and c.colour is not None and any(w in low(r.colour) for w in ("red", "white")):
        if not any(w in low(r.colour) and w in low(c.colour) for w in ("red", "white")):
            return False
    if any("assortment" in low(x) for x in (c.display_name, c.wine)) or any(w in low(x) for w in ("mixed", "assortment", "vertical", "collection", "selection") for x in (r.name, r.lot_producer)):
        return False
    if not (r.lot_producer or "").strip():
        return False
    if "bordeaux" in low(r.region) or "bordeaux" in low(r.sub_region):
        name, producer = (" ".join(re.sub(r"[^\w\s]|_", " ", without(x, ("château", "chateau", "vintage"))).lower().split()) for x in (r.name, c.producer_name))
        if not (producer in name or edits(producer, name) <= 2):
            return False
    if all(x and "burgundy" not in low(x) for x in (r.region, r.country, r.sub_region)):
        return True
    name = without(r.name, ("Château le", "Chateau le", "Château", "Chateau")).lower().strip()
    place = not r.sub_region or not c.sub_region or low(r.sub_region) == low(c.sub_region) or plain(c.sub_region) in name
    lot, theirs = plain(r.lot_producer), plain(c.producer_name)
    whole = plain(f"{c.producer_title or ''} {c.producer_name or ''}")
    return place and (lot in (theirs, whole) or theirs in name or plain(c.producer_title) in mapped(name))


@pytest.fixture(scope="module")
def matched(spark, sf_dir):
    """{request id: [(score, code)], best first} of all requests, with every pair of a name and a row scored."""
    asked = texts.requests(spark, sf_dir).withColumns({"name": clean_title(F.col("wine_name")), "producer": F.lower(clean_title(F.col("lot_producer")))}).collect()
    known = views.catalogue(spark, sf_dir).withColumns({"clean": clean_title(F.col("display_name")), "text": clean_title(F.concat_ws(" ", "display_name", "producer_name", "wine"))}).collect()
    held = {c.id: Counter(stem(t) for t in tokens(c.text)) for c in known}
    df = Counter(t for words in held.values() for t in words)
    mean = sum(w.total() for w in held.values()) / len(held)
    idf = {t: math.log(1 + (len(held) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    out = {}
    for r in asked:
        out[r.request_id] = []
        if not r.name or not (r.lot_producer or "").strip():
            continue
        times = Counter(stem(t) for t in tokens(r.name))
        bm25 = {}
        for d, words in held.items():
            norm = matching.K1 * (1 - matching.B + matching.B * words.total() / mean)
            s = sum(n * idf[t] * words[t] / (words[t] + norm) for t, n in times.items() if t in words)
            if s:
                bm25[d] = s
        place = {d: k for k, d in enumerate(sorted(bm25, key=lambda d: (-round(bm25[d], 9), d))[:50])}
        found = []
        for c in known:
            if c.id not in place or not allowed(r, c):
                continue
            damped = math.log1p(bm25[c.id]) / (math.log1p(bm25[c.id]) + 1)
            score = 0.7 * damped + 0.3 * max(ratio(r.name, c.clean), ratio(r.name, mapped(c.clean))) / 100
            second = lambda x: any(w in (x or "").lower() for w in matching.SECOND_WINES)
            score -= 0.02 * (not second(r.name) and (second(c.wine) or second(c.display_name)))
            score += 0.04 * (bool(c.sub_region) and ratio(r.name, plain(c.sub_region)) >= 90)
            if r.producer:
                near = ratio(c.producer_name.lower(), r.producer) / 100
                score += 0.02 if near >= 0.95 else -0.05 if near < 0.8 else 0
            found.append((-max(0.0, score), place[c.id], c.lwin if c.reference is None else math.floor(float(c.reference))))
        out[r.request_id] = [(-s, code) for s, _, code in sorted(found)[:5]]
    return out


def kept(found):
    """(class, codes) of a request's best matches."""
    top = found[0][0] if found else 0
    kind = "exact_match" if top >= matching.EXACT else "multi_match" if top >= matching.MULTI else "not_match"
    return kind, found[:1] if kind == "exact_match" else found if kind == "multi_match" else []


def test_match_equals_brute_force(spark, sf_dir, matched):
    got = {r.request_id: r for r in texts.k7_match(spark, sf_dir).collect()}
    assert got.keys() == matched.keys() and len({r.matched for r in got.values()}) > 1
    for k, found in matched.items():
        kind, best = kept(found)
        assert (got[k].matched, got[k].n) == (kind, len(best)), k
        if best:
            assert got[k].score_1 == pytest.approx(best[0][0], abs=1e-4) and got[k].lwin_1 in {c for s, c in best if s > best[0][0] - 1e-9}, k


def test_evaluation_equals_brute_force(spark, sf_dir, matched):
    code = {c.id: c.lwin if c.reference is None else math.floor(float(c.reference)) for c in views.catalogue(spark, sf_dir).collect()}
    first = {k: best[0][1] if best else None for k, (_, best) in ((k, kept(found)) for k, found in matched.items())}
    right, none = sum(c == code[k] for k, c in first.items()), sum(c is None for c in first.values())
    got = stores.k14_match_evaluation(spark, sf_dir).first()
    assert (got["items"], got.correct, got.wrong, got.missing) == (len(first), right, len(first) - right - none, none)
    assert got.accuracy == pytest.approx(100 * right / len(first), abs=0.006)


def test_metadata_equals_brute_force(spark, sf_dir):
    known = views.catalogue(spark, sf_dir).collect()
    titles = {r.p_partkey: f"{r.p_name} {r.p_brand} {r.p_type}" for r in views.read(spark, sf_dir, "part").collect()}
    held = {c.id: Counter(tokens(c.wine)) for c in known}
    df = Counter(t for words in held.values() for t in words)
    idf = {t: math.log((1 + len(known)) / (1 + n)) + 1 for t, n in df.items()}
    vector = lambda words: {t: n * idf[t] for t, n in words.items() if t in idf}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    rows, by_term = {d: vector(w) for d, w in held.items()}, defaultdict(set)
    for d, w in held.items():
        for t in w:
            by_term[t].add(d)
    of = {c.id: c for c in known}
    got = {r.lot_id: r for r in texts.k10_infer_metadata(spark, sf_dir).collect()}
    assert got.keys() == titles.keys()
    seen = Counter()
    for k in sorted(titles):
        q, title, scores = vector(Counter(tokens(titles[k]))), titles[k].lower(), {}
        for d in set().union(*(by_term[t] for t in q)):
            c, cosine = of[d], sum(x * rows[d].get(t, 0) for t, x in q.items()) / length(q) / length(rows[d])
            scores[d] = 0.3 * cosine + 0.3 * ratio(title, c.wine.lower()) + 0.2 * ratio(title, c.producer_name.lower()) + 0.2 * ratio(title, c.sub_region.lower())
        top = max(scores.values(), default=0)
        best = [d for d, s in scores.items() if s > top - 1e-6]
        status = "not_found" if top <= 40 else "ambiguous" if len(best) > 1 else "found"
        c = of[best[0]] if status == "found" else None
        assert tuple(got[k]) == (k, status, *((c.producer_name, c.region, c.sub_region) if c else (None, None, None))), k
        seen[status] += 1
    assert seen["found"]


def test_term_stems_are_those_of_all_terms(spark, sf_dir):
    want = {t for r in views.read(spark, sf_dir, "documents").select("text").collect() for t in tokens(r.text)}
    got = {r.term: r.stem for r in texts.k1_term_stems(spark, sf_dir).collect()}
    assert got == {t: stem(t) for t in want}
