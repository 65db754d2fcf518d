"""Operators 1, 2, 3, 6, 7 and 8 on small cases and by held-out accuracy."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F

from lotwise.llm import decontaminate, language, pii, quality, toxicity, wrappers
from lotwise.llm.common import held_out, table
from tests.conftest import SF

DATA = SF.replace("sf0.001", "sf0.01")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            out = [i]
            for j, y in enumerate(b, 1):
                out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = out
        return row[-1]

    terms = ["idiot", "moron", "disgusting", "scum", "lowei*", "stupidest"]
    a = toxicity.Automaton(terms)
    words = ["idiot", "idot", "idiiot", "idxxt", "mron", "morons", "disgustng", "disgusstinng", "scum", "scam", "loweix", "lowei", "lowe", "stupidst", "", "thing"]
    for w in words:
        near = []
        for k, t in enumerate(terms):
            most = toxicity.budget(t)
            ends = [w[:n] for n in range(len(w) + 1)] if t.endswith("*") else [w]
            d = min(distance(e, t.rstrip("*")) for e in ends)
            if d <= most:
                near.append((d, k))
        assert a.match(w) == min(near, default=None), w


def test_automaton_inserts_before_the_first_letter():
    a = toxicity.Automaton(["idiot", "disgusting"])
    assert [a.match(w) for w in ("xidiot", "xxidiot", "xxdisgusting", "xdisgustng", "xxxdisgusting")] == [(1, 0), None, (2, 1), (2, 1), None]


def test_rare_terms_beside_near_copies():
    # 5000 words of a text in 60 near copies, each word missing from a few, and a slur of 5 documents
    copies = [{f"w{chr(97 + k % 26)}{k:04d}x" for k in range(5000) if (k * 7 + d) % 29} for d in range(60)]
    docs = copies + [{"moron"} for _ in range(5)]
    assert "moron" in toxicity.choose(docs, set().union(*docs))


def test_toxicity_held_out(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = toxicity.fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    got = toxicity.score(docs, model).join(labels, "doc_id").select("doc_id", "score", "toxic", held_out(F.col("doc_id")).alias("h")).collect()
    toxic, clean = [r.score >= 0.5 for r in got if r.toxic == 1], [r.score >= 0.5 for r in got if r.toxic == 0]
    right = [(r.score >= 0.5) == (r.toxic == 1) for r in got if r.h]
    assert len(right) > 30 and sum(right) / len(right) >= 0.95
    assert sum(toxic) / len(toxic) >= 0.65 and sum(clean) / len(clean) <= 0.02  # some 40 toxic texts to learn from
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "x " * 50_000)], "doc_id long, text string")
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r.score < 0.5 for r in rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the larger tables are not there")
def test_toxicity_recall_and_precision(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = toxicity.op1_toxicity(spark, "/root/testdata/sf0.1").join(labels.select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    toxic, alarms = [r.predicted for r in got if r.toxic == 1 and r.held_out], [r for r in got if r.toxic == 0 and r.held_out and r.predicted]
    assert sum(toxic) / len(toxic) >= 0.9 and len(alarms) <= 5
    # in each language, over held-out and learned rows, as some have fewer than ten held-out ones
    for lang in ("en", "de", "fr", "es"):
        of = [r.predicted for r in got if r.toxic == 1 and r.lang == lang]
        assert len(of) > 20 and sum(of) / len(of) >= 0.8, lang


def test_toxicity_clash(spark):
    docs = spark.createDataFrame([(1, "you idiot", 5.0, "x")], "doc_id long, text string, score double, terms string")
    labels = spark.createDataFrame([(1, 1, "x")], "doc_id long, toxic int, text string")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 1


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "idiot")], "doc_id long, text string")
    assert toxicity.score(docs, toxicity.fit(docs, none)).first().score == 0.0


def test_quoted_hits_weigh_apart():
    m = toxicity.Model(["idiot"])
    assert m.features('they said "idiot" to me')[4] > 0 and m.features("you idiot")[0] == 1.0
    assert not any(m.features(None))
    assert m.features('"' + "idiot " * 3000 + '"')[4] > 0 and m.features("idiot " * 3000)[0] == 1.0  # marks are searched, not scanned
    assert m.features("İİİİ you idiot, they")[0] == 1.0


def test_odd_marks_turn_nothing_round():
    m = toxicity.Model(["idiot"])
    assert m.features('a 12" shelf, you idiot, and "so on"')[0] == 1.0  # the mark of inches opens nothing
    assert m.features('he wrote "idiot" on a 12" shelf')[0] == 0.0
    assert m.features('one " alone, then “idiot” again')[4] > 0
    assert toxicity.quotations('"a b" c "d') == [(0, 4)] and toxicity.quotations("„so“ «und» »wo«") == [(0, 3), (5, 9), (11, 14)]
    assert toxicity.quotations('"') == [] and toxicity.quotations("") == []


def test_toxicity_of_no_documents_and_ties(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, "you utter idiot" if k % 2 else "a fine day") for k in range(40)], "doc_id long, text string")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.fit(docs.limit(0), labels).terms == []
    rows = toxicity.score(docs.union(docs), model).collect()  # repeated rows each give a row, equal texts the same score
    assert len(rows) == 80 and len({(r.doc_id % 2, r.score) for r in rows}) == 2


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = out
    return row[-1]


def test_hits_equal_brute_force():
    terms = ["idiot", "disgusting", "scum", "lowei*", "réêou"]
    m = toxicity.Model(terms, [3.0, 4.0, 2.0, 1.0, 5.0])
    texts = ["You Idiot, idiots! disgstng scums", "a loweiant REPLY; réêou réêoux", "", "said scum, then xidiot " * 5, "nothing here at all"]
    for text in texts:
        want = []
        for i, w in enumerate(re.findall(r"[^\W\d_]+", text.lower())):
            near = []
            for k, t in enumerate(terms):
                ends = [w[:n] for n in range(len(w) + 1)] if t.endswith("*") else [w]
                d = min(plain_distance(e, t.rstrip("*")) for e in ends)
                if d <= toxicity.budget(t):
                    near.append((d, k))
            if near:
                want.append((i, *min(near)))
        assert m.hits(text)[0] == want, text


def test_families_of_terms_are_all_chosen():
    # one form of a family must not keep the others out
    docs = [{f"achlich{chr(97 + (d + k) % 20)}{chr(98 + (d + k) % 20)}" for k in range(3)} for d in range(60)]
    assert len(toxicity.choose(docs, set().union(*docs))) >= 15


def test_language_held_out(spark):
    docs = table(spark, DATA, "documents")
    model = language.fit(docs.filter(~held_out(F.col("doc_id"))))
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").select("lang", "lang_pred", "score", held_out(F.col("doc_id")).alias("h")).collect()
    right = [r.lang == r.lang_pred for r in got if r.h and r.lang]
    assert len(right) > 100 and sum(right) / len(right) >= 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (None, "der die das und nicht")], "doc_id long, text string")
    rows = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [rows[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and rows[None].lang_pred != "und"
    full = odd.withColumn("lang", F.lit(None).cast("string"))
    assert [r.doc_id for r in language.keep_identified(full, model).collect()] == [None]
    assert [r.doc_id for r in language.keep_identified(full, language.fit(full)).collect()] == [None]


def test_language_equals_brute_force(spark):
    import math

    rows = [(k, t, lang, "x") for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr"), ("The old house", "en"), ("ein altes Haus", "de"), ("une vieille maison", "fr")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = language.fit(docs)

    def buckets(text):
        t = re.sub(r"[^a-zà-ÿ]+", " ", text.lower())
        mixed, mask = 0x1F123BB5, (1 << 64) - 1
        one = [ord(c) for c in t]
        two = [(a * mixed + b) & mask for a, b in zip(one, one[1:])]
        three = [(a * mixed + b) & mask for a, b in zip(two, one[2:])]
        return [((x * 0x9E3779B97F4A7C15) & mask) >> 50 for x in one + [x + (1 << 40) for x in two] + [x + (1 << 41) for x in three]]

    langs = sorted({r[2] for r in rows})
    count = {k: [0.5] * language.BUCKETS for k in langs}
    for _, t, lang, _ in rows:
        g = buckets(t)
        for b in g:
            count[lang][b] += min(len(g), 400) / len(g)
    p = {k: [x / sum(c) for x in c] for k, c in count.items()}
    code = language.codewords(3)
    weight = [[math.log(sum(p[k][b] for i, k in enumerate(langs) if code[i][j]) / sum(code[:, j])) - math.log(sum(p[k][b] for i, k in enumerate(langs) if not code[i][j]) / (3 - sum(code[:, j]))) for b in range(language.BUCKETS)] for j in range(code.shape[1])]
    strength = [sum(abs(sum(x * w for x, w in zip(p[k], weight[j]))) for k in langs) / 3 + 1e-9 for j in range(code.shape[1])]
    for text in ("the dog", "und das Haus", "le chien", "maison et chat"):
        g = buckets(text)
        loss = []
        for i in range(3):
            margins = [sum(weight[j][b] for b in g) / len(g) * min(len(g), 40) * (1 if code[i][j] else -1) for j in range(code.shape[1])]
            loss.append(sum(s / sum(strength) / (1 + math.exp(m)) for s, m in zip(strength, margins)))
        lang, score, _ = model.predict(text)
        assert lang == langs[loss.index(min(loss))] and abs(score - (1 - min(loss))) < 1e-6
    assert language.identify(docs, model).columns[1] == "lang_pred"
    assert model.predict("µ º")[0] != "und"


def test_codewords_differ():
    for k in (2, 4, 6, 12):
        code = language.codewords(k)
        assert min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= (1 if k == 2 else code.shape[1] // 4)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text, re.A):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


PII = [
    None, "", "mail a@b.c_d@e.f and x@y", "a@b.c a+b@c-d.e.f.g, 😀 é me@x.org", "1.2.3.4 256.1.1.1 001.002.003.255 1.2.3.4.5.6.7.8 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111",
    "+1 (555) 555-0100 +12 +1234567890123456 call +44 20 7946 0958.", "x" * 5000 + "@" + "y" * 5000 + ".z", "1" * 30_000, "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, GB82WEST12345698765433", "ssn 123-45-6789, other 123-45-6789" + "." * 60 + " 987-65-4321",
    "a@" + "b." * 4000 + "c", "+" + "1 " * 4000, "1-2-3-4", "9" * 13, "0" * 16,
]


def test_pii_spans_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(PII)], "doc_id long, text string, spans_x string")
    for r in pii.find_pii(docs).collect():
        got = [(x.kind, x.start, x.end) for k in pii.BASE for x in r[f"spans_{k}"]]
        assert got == base_spans(PII[r.doc_id] or ""), r.doc_id
    extra = {r.doc_id: [(x.kind, PII[r.doc_id][x.start : x.end]) for k in pii.EXTRA for x in r[f"spans_{k}"]] for r in pii.find_pii(docs).collect()}
    assert extra[9] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert ("nid", "123-45-6789") in extra[10] and ("nid", "987-65-4321") not in extra[10]
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_pii_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.co", 7, 8, 9)], "doc_id long, text string, found_email int, _spans int, _found_ip int")
    row = pii.find_pii(docs).first()
    assert row.found_email == 7 and len(row.spans_email) == 1
    assert pii.redact(docs).first().asDict() == {"doc_id": 1, "text": "[EMAIL]", "found_email": 7, "_spans": 8, "_found_ip": 9}


def test_pii_redaction(spark):
    docs = spark.createDataFrame([(1, "é a@b.co or 1.2.3.4, 4111 1111 1111 1111; +44 20 7946 0958"), (2, None), (3, "clean 12")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got == {1: "é [EMAIL] or [IP], [CARD]; [PHONE]", 2: None, 3: "clean 12"}


def test_pii_redaction_of_overlapping_spans(spark):
    texts = ["call +33.1.42.68.53.00 now", "4111 1111 1111 1111@b.co and é 1.2.3.4", "+1 (555) 555-0100a@b.co", "ssn" + "." * 60 + " 987-65-4321", "987-65-4321"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in pii.redact(docs).orderBy("doc_id").collect()]
    assert got == ["call [PHONE] now", "[CARD] and é [IP]", "[PHONE]", "ssn" + "." * 60 + " [NID]", "987-65-4321"]
    for r in pii.find_pii(docs).collect():
        for x in [x for k in pii.BASE for x in r[f"spans_{k}"]]:
            assert texts[r.doc_id][x.start : x.end] not in got[r.doc_id]


BENCH = [(1, "The train of Alice leaves at 10 in the morning and covers 120 km before noon, so how fast does the train of Alice go?"), (2, "Short item."), (3, None), (4, "")]


def test_decontamination(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    exact, clean = BENCH[0][1], "Some quite different words stand here and nothing of any known question is in this text at all, none."
    other = exact.replace("Alice", "Bob").replace("10", "11").replace("120", "150")
    mixed = exact.replace("Alice", "Bob", 1).replace("120", "150")
    docs = spark.createDataFrame([(1, "Before. " + exact + " After."), (2, "x " * 30 + other), (3, clean), (4, None), (5, ""), (6, mixed), (7, "Short item."), (7, "Short item."), (None, exact)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert {k for k in got} == {(1, 1), (2, 1), (7, 2), (None, 1)} | ({(6, 1)} & set(got))
    assert got[(1, 1)].n_changed == 0 and got[(2, 1)].n_changed >= 3
    full = got[(1, 1)].n_windows
    assert full == got[(1, 1)].item_windows and ((6, 1) not in got or got[(6, 1)].n_windows < full)
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()) == [3, 4, 5] + ([] if (6, 1) in got else [6])
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_sentence_starts_equal_the_plain_pattern(spark):
    import random

    rng = random.Random(8)
    texts = ["".join(rng.choice("aBÉ .!:\n\n \"')]") for _ in range(rng.randrange(30))) for _ in range(3000)] + ["\n" * 60_000 + "a", "x" + " \n" * 30_000 + "A"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows.select("doc_id", F.regexp_replace("text", decontaminate.SENTENCE_ONCE, "$1\x01$2").alias("t")).collect()
    plain = re.compile(decontaminate.SENTENCE.replace(r"\p{Lu}", "[A-ZÉ]"))
    for r in got:
        if len(texts[r.doc_id]) < 1000:
            assert r.t == plain.sub("\\1\x01\\2", texts[r.doc_id]), repr(texts[r.doc_id])
    assert got[-1].t.endswith("\x01A")


def test_one_conflicting_slot_spares_the_other_windows(spark):
    item = "First 5 rows of the green table go to the left side of the house and then 5 more of them go up to the old mill by the river"
    doc = item.replace("5 rows", "6 rows")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "So: " + doc), (2, item.replace("green", "red").replace("left", "right").replace("then", "now").replace("up", "on"))], "doc_id long, text string")
    got = decontaminate.find_leaks(docs, bench).collect()
    assert [(r.doc_id, r.n_slots) for r in got] == [(1, 0)]


def test_decontamination_clash_and_long_text(spark):
    bench = spark.createDataFrame([(1, BENCH[0][1], 3, "x")], "item_id long, text string, doc_id int, h string")
    docs = spark.createDataFrame([(1, "word " * 60_000 + BENCH[0][1], 5, "y"), (2, "word " * 60_000, 5, "y")], "doc_id long, text string, item_id int, slots string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()] == [(1, 1)]
    assert [r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()] == [2]


def test_decontamination_without_broadcast(spark, monkeypatch):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = spark.createDataFrame([(1, BENCH[0][1]), (2, "none")], "doc_id long, text string")
    want = decontaminate.find_leaks(docs, bench).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert decontaminate.find_leaks(docs, bench).collect() == want


def test_decontamination_second_form(spark):
    cases = [
        ("12 kg and 15 kg for 3 hours", "She lifted 12 kg and 15 kg for 3 hours yesterday."),
        ("17 cm or 19 cm in 4 days", "She cut 20 mm or 25 mm in 9 weeks yesterday."),
        ("3 1 4 1 5 9 2 6 5", "so the list is 3 1 4 1 5 9 2 6 5 here"),
        ("Short item.", "Before. Short item. After it come more words than that."),
        ("Other tiny thing", "there is some other tiny thing in this text of many words"),
        ("How fast does the old train go now?", "They asked How fast does the old train go now and left"),
        ("The bus of Alice leaves the old station at noon today", "The bus of Mary Ann Smith leaves the old station at noon today"),
        ("Alice takes the new boat to the sea today", "It rained. Mary Ann takes the new boat to the sea today"),
    ]
    bench = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(cases)], "item_id long, text string")
    clean = "She has 7 kg of quite different things and 8 1 2 3 4 5 6 7 9 of them, but nothing short or fast."
    docs = spark.createDataFrame([(k, doc) for k, (_, doc) in enumerate(cases)] + [(50, clean), (51, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()) == [(k, k) for k in range(len(cases))]
    assert [r.doc_id for r in decontaminate.drop_leaks(docs, bench).orderBy("doc_id").collect()] == [50, 51]


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a>Home</a></li><li><a>All</a></li></ul></nav><div class="ad">Buy</div><article><h1>{t}</h1>{ps}</article><div class="comments"><p>first!</p></div><aside>s</aside><form><label>Mail</label></form><footer>&copy; x</footer></body></html>'


def test_wrappers_and_regions():
    pages = [PAGE.format(t=f"Title {k}", ps="".join(f"<p>Par {j} &amp; <b>b</b>\n  x<script>var a='<p>'</script></p>" for j in range(k))) for k in (1, 2, 5, 3)]
    w = wrappers.infer(pages)
    for k, page in zip((1, 2, 5, 3), pages):
        want = "\n".join([f"Title {k}", *[f"Par {j} & b x" for j in range(k)]])
        assert wrappers.extract_page(page, w) == (want, True)
        assert wrappers.extract_page(page) == (want, False)


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("just &lt;text&gt;  here", "just <text> here"), ("<p>one<p>two", "one\ntwo"), ("<div class=ad>x<article>y</article>", "y"), ("<script>x", ""),
    ("<main><p>a<br>b</p></main><p>out</p>", "a\nb"), ("<body><div class='cookie-notice'>c</div><p>t</p></body>", "t"), ("<p>" + "w " * 50_000 + "</p>", ("w " * 50_000).strip()), ("<article>a<nav>n</article>b", "a"),
])
def test_single_pages(page, want):
    assert wrappers.extract_page(page)[0] == want


@pytest.mark.parametrize("page,want", [
    ("<p><b>one</b> <i>two</i></p>", "one two"), ("<article><a>this</a> <em>word</em>.</article>", "this word."), ("<article>x <math>a+b</math> y</article>", "x a+b y"),
    ('<main class="search-results"><p class="share-price">42</p></main>', "42"), ("<main><h1>T</h1><p>long text</p></main><aside><article>Other</article></aside>", "T\nlong text"),
    ("<div class='site-footer'>f</div><p>t</p>", "t"), ("<p title=it's>a</p><p>don't</p>", "a\ndon't"), ("<a b <p>t</p>", "<a b\nt"), ("<p>a &amp;amp; b</p>", "a &amp; b"),
])
def test_pages_that_were_cut(page, want):
    assert wrappers.extract_page(page)[0] == want


@pytest.mark.parametrize("junk", ["<a ", "<!", '<a b="', "<script ", "<a x='", "&#", "<div class=ad>", "<nav>"])
def test_tokens_take_linear_time(junk):
    began = time.time()
    wrappers.extract_page(junk * 40_000)
    assert time.time() - began < 5


BARE = '<html><body><div class="q1"><p>Our shop since 1950</p></div><div class="q2"><h2>{t}</h2>{ps}<p>Share this page</p></div><div class="q3"><p>{a}</p></div></body></html>'


def bare_pages(n):
    return [BARE.format(t=f"Title {k}", ps="".join(f"<p>text {k} {j} of it, which goes on for some more words</p>" for j in range(1 + k % 3)), a="All rights" if k else "No rights") for k in range(n)]


def test_slots_decide_where_names_say_nothing(spark):
    pages = bare_pages(30)
    rows = [(k, f"http://bare.example/{k}", p) for k, p in enumerate(pages)] + [(100 + k, f"http://bare.example/c{k}", pages[3]) for k in range(5)]
    table_ = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = wrappers.fit(table_)
    got = {r.page_id: r for r in wrappers.extract(table_, made).collect()}
    for k in range(30):
        want = [f"Title {k}", *[f"text {k} {j} of it, which goes on for some more words" for j in range(1 + k % 3)]]
        # the last text differs on page 0 alone, wherever that page is in the sample: it is no template
        assert got[k].matched and got[k].text.split("\n") == want + ["All rights" if k else "No rights"], k
    assert wrappers.extract_page(pages[4])[0] != got[4].text and got[103].text == got[3].text


def test_all_pages_of_a_host_make_its_wrapper(spark):
    """Structures that few of a host's many pages have are in its wrapper."""
    pages = bare_pages(400)
    rare = {k: f'<p>Boxed {k}</p><table class="r{k % 4}"><tr><td>cell {k}</td></tr></table>' for k in range(7, 400, 50)}
    rows = [(k, f"http://bare.example/{k}", p.replace("<p>Share", rare.get(k, "") + "<p>Share")) for k, p in enumerate(pages)]
    table_ = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in wrappers.extract(table_, wrappers.fit(table_)).collect()}
    assert len(got) == 400 and all(r.matched for r in got.values())
    assert all(f"Boxed {k}\ncell {k}" in got[k].text and "Our shop" not in got[k].text for k in rare)


def test_partial_wrappers_match_what_each_matches():
    import random

    rng = random.Random(12)
    parts = ["<h2>a{k}</h2>", "<p>b{k}<br>c", "<p>d{k}</p>", "<ul><li>e{k}</li><li>f</li></ul>", "<div class=x>g{k}</div>", "<i>h</i>", "<b>i{k}</b><br>"]
    for _ in range(30):
        groups = [["".join(rng.choice(parts).format(k=rng.randrange(9)) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 6))] for _ in range(4)]
        made = wrappers.finished(wrappers.together([wrappers.unpacked(wrappers.packed(wrappers.partial(g))) for g in groups]))
        assert all(wrappers.extract_page(p, made)[1] for g in groups for p in g)


def test_copies_are_no_template(spark):
    page = bare_pages(2)[1]
    rows = [(k, f"http://copies.example/{k}", page.replace("text 1 0", f"text {k} zero")) for k in range(20)]
    table_ = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = [r.text for r in wrappers.extract(table_, wrappers.fit(table_)).collect()]
    assert all("Our shop since 1950" in t and "of it" in t for t in texts)


def test_alignment_equals_brute_force():
    """A wrapper matches all its pages, and keeps the longest common sequence of two pages without repeats."""
    import random

    def common(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = random.Random(4)
    tags = [f"<i{k}>" for k in range(9)]
    for _ in range(60):
        base = rng.sample(tags, 7)
        pages = ["".join(t for t in base if rng.random() < 0.8) for _ in range(2)]
        if not all(pages):
            continue
        w = wrappers.align(*[wrappers.leaves_of(p) for p in pages])
        assert sum(i[0] == "t" for i in w) == common(*[re.findall("<i.>", p) for p in pages])
        made = wrappers.infer(pages)
        assert all(wrappers.extract_page(p, made)[1] for p in pages)


def test_extraction_query_rows(spark):
    rows = [(1, "http://h.example/1", PAGE.format(t="A", ps="<p>x</p>")), (1, "http://h.example/1", PAGE.format(t="A", ps="<p>x</p>")), (2, None, "<p>n</p>"), (None, "odd", None)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = wrappers.extract(pages, wrappers.fit(pages)).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (1, "A\nx"), (1, "A\nx"), (2, "n")]
    assert wrappers.extract(pages.limit(0), wrappers.fit(pages.limit(0))).count() == 0


@pytest.mark.parametrize("name", "user-comments comment-thread article-comments post-comments c-comment related-posts related-articles ad-slot site-ad-unit adsbygoogle share-buttons gdpr-notice breadcrumb-trail".split())
def test_compound_names_of_boilerplate(name):
    page = f'<article><p>One</p><div class="{name}"><p>inner words</p></div><p>Two</p></article>'
    assert wrappers.extract_page(page)[0] == "One\nTwo"
    assert wrappers.extract_page(f'<body><p>One</p><div class="{name}"><p>inner words</p></div></body>')[0] == "One"


@pytest.mark.parametrize("name", "share-price page-with-sidebar has-comments-off adventure commented article-body post entry-content menu-list recipe-menu category-legal".split())
def test_names_of_content(name):
    page = f'<article><p>One</p><div class="{name}"><p>inner words</p></div><p>Two</p></article>'
    assert wrappers.extract_page(page)[0] == "One\ninner words\nTwo"


@pytest.mark.parametrize("page,want", [
    ("<p>Tag <label>cheese</label> here</p>", "Tag cheese here"), ("<p>t</p><div><label>Email</label> <input></div>", "t"), ("<p>t</p><div><label>Email</label></div>", "t"),
    ('<article><p>Food</p><ul class="menu-list"><li>Soup</li><li>Fish</li></ul><ul class="menu"><li><a href=x>Home</a></li></ul></article>', "Food\nSoup\nFish"),
    ('<p>t</p><div role="contentinfo">c</div>', "t"),
])
def test_labels_and_menus(page, want):
    assert wrappers.extract_page(page)[0] == want


def test_matcher_equals_regular_expressions():
    import random

    rng = random.Random(7)

    def made(depth):
        return [[rng.randrange(3), rng.randrange(2)] if depth == 0 or rng.random() < 0.6 else [rng.choice("+?"), made(depth - 1)] for _ in range(rng.randint(1, 3))]

    def sound(items):  # a repeat always holds something that is not optional
        return all(isinstance(i[0], int) or sound(i[1]) and (i[0] == "?" or any(x[0] != "?" for x in i[1])) for i in items)

    def plainly(items):
        return "".join("abc"[i[0]] if isinstance(i[0], int) else f"(?:{plainly(i[1])}){i[0]}" for i in items)

    tried = hits = 0
    while tried < 300:
        items = made(2)
        if not sound(items):
            continue
        tried += 1
        m, r = wrappers.Matcher(items), re.compile(plainly(items))
        for _ in range(40):
            word = [rng.randrange(3) for _ in range(rng.randint(0, 6))]
            of = m.groups_of(word)
            assert (of is not None) == (r.fullmatch("".join("abc"[c] for c in word)) is not None), (items, word)
            hits += of is not None
    assert hits > 300


def test_fitted_pages_are_matched():
    import random

    rng = random.Random(11)
    parts = ["<h2>a{k}</h2>", "<p>b{k}<br>c", "<p>d{k}</p>", "<ul><li>e{k}</li><li>f</li></ul>", "<div class=x>g{k}</div>", "<i>h</i>", "<b>i{k}</b><br>"]
    for _ in range(40):
        pages = ["".join(rng.choice(parts).format(k=rng.randrange(9)) for _ in range(rng.randint(1, 14))) + rng.choice(["", "</body></html>"]) for _ in range(10)]
        made = wrappers.infer(pages)
        assert all(wrappers.extract_page(p, made)[1] for p in pages)


def test_a_large_irregular_page_leaves_the_wrapper():
    import random

    rng = random.Random(3)
    page = '<html><body><div class="q1"><p>Our shop</p></div><div class="q2"><h2>T{k}</h2><p>text {k}</p></div></body></html>'
    odd = "<html><body>" + "".join(rng.choice(["<u>x</u>", "<i>y</i><br>", "<b>z", "<s>w</s>"]) for _ in range(4 * wrappers.MAX_SYMBOLS)) + "</body></html>"
    for pages in ([odd] + [page.format(k=k) for k in range(6)], [page.format(k=k) for k in range(6)] + [odd]):
        made = wrappers.infer(pages)
        assert wrappers.extract_page(page.format(k=77), made) == ("T77\ntext 77", True) and wrappers.extract_page(odd, made)[1] is False


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the larger tables are not there")
def test_most_pages_are_matched(spark):
    rows = wrappers.op2_html_extraction(spark, "/root/testdata/sf0.1").select("matched").collect()
    assert sum(r.matched for r in rows) / len(rows) >= 0.98


def test_extraction_with_clashing_columns(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.format(t=f"A{k}", ps=f"<p>x{k}</p>"), "w", ["v"], 1) for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string, varied array<string>, salt int")
    got = wrappers.extract(pages, wrappers.fit(pages)).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(k, f"A{k}\nx{k}") for k in range(6)]


def test_extraction_query_equals_page_by_page(spark):
    """The query's rows are those of wrappers made and applied page by page, on hosts of fewer than PAGES pages."""
    pages = table(spark, DATA, "pages")
    made = {}
    by_host = {}
    for r in pages.select("page_id", "html", wrappers.host(F.col("url")).alias("h"), F.xxhash64("html").alias("x")).collect():
        by_host.setdefault(r.h, []).append(r)
    small = {h: rows for h, rows in by_host.items() if len({r.x for r in rows}) <= wrappers.PAGES}
    assert small
    for h, rows in small.items():
        different = {r.x: r.html for r in rows if r.html}
        w = wrappers.infer([different[x] for x in sorted(different)])
        lacking = frozenset(g for r in rows if r.html and w for g in wrappers.absent(r.html, w))
        made |= {r.page_id: wrappers.extract_page(r.html, w, lacking)[0] for r in rows}
    got = {r.page_id: r.text for r in wrappers.op2_html_extraction(spark, DATA).collect()}
    assert {k: got[k] for k in made} == made


def test_quality_accuracy(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    got = quality.judge(docs).join(labels, "doc_id").select("keep", "quality").collect()
    assert sum(r.keep == (r.quality == 1) for r in got) / len(got) >= 0.95
    kept_clean = [r.keep for r in got if r.quality == 1]
    assert sum(kept_clean) / len(kept_clean) >= 0.97


def test_label_model_equals_per_document():
    import math

    patterns = {"22222222": 300, "02222222": 20, "22220022": 15, "11222111": 9, "00202022": 8, "11111111": 3, "20222222": 2}
    docs = [p for p, n in patterns.items() for _ in range(n)]
    size = len(quality.LABELLERS)
    post = {}
    for p in patterns:
        bad, ok = [c == "0" for c in p], "2" in p
        good = 1e-3 if any(bad) else 1 - 1e-3 if ok else 0.5
        spread = [float(b) for b in bad] if any(bad) else [1.0] * size
        post[p] = [good, *((1 - good) * x / sum(spread) for x in spread)]
    for _ in range(100):
        share = [(sum(post[d][c] for d in docs) + 1) / (len(docs) + size + 1) for c in range(size + 1)]
        rate = []
        for c in range(size + 1):
            before = [quality.CATCH if j == c - 1 else quality.MISFIRE for j in range(size)]
            rate.append([(sum(post[d][c] for d in docs if d[j] == "0") + quality.PRIOR * before[j]) / (sum(post[d][c] for d in docs if d[j] != "1") + quality.PRIOR) for j in range(size)])
        for p in patterns:
            z = [share[c] * math.prod(rate[c][j] if p[j] == "0" else 1 - rate[c][j] if p[j] == "2" else 1.0 for j in range(size)) for c in range(size + 1)]
            post[p] = [x / sum(z) for x in z]
    got = quality.label_model(patterns)
    assert all(abs(got[p] - post[p][0]) < 1e-4 for p in patterns)
    assert got["22222222"] > 0.9 and got["02222222"] < 0.1 and got["22220022"] < 0.1


def test_quality_scores_equal_brute_force():
    import numpy as np

    rng = np.random.default_rng(1)
    scorer = quality.Scorer(rng.normal(size=quality.FEATURES), 0.3)
    texts = ["Plain words stand here.", "x | y | z !!! " * 20, "again again\nagain again"]
    got = [quality.features(t) for t in texts]
    flat = scorer.score(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), np.array([len(g[0]) for g in got]))
    for (at, x), s in zip(got, flat):
        assert len(set(at)) == len(at) and abs(s - 1 / (1 + np.exp(-(sum(scorer.weights[i] * v for i, v in zip(at, x)) + 0.3)))) < 1e-9


def test_quality_odd_rows(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "Plain words stand here.")], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality.judge(odd).collect()}
    assert [rows[k].keep for k in (1, 2, 3)] == [False] * 3 and rows[None].keep
    assert quality.judge(odd.limit(0)).count() == 0
    more = spark.createDataFrame([(1, "Plain words stand here and more of them do. " * 20_000, "v", 0.1), (1, "tie", "v", 0.1), (1, "tie", "v", 0.1)], "doc_id long, text string, votes string, score double")
    got = quality.judge(more).collect()
    assert len(got) == 3 and len({(r.score, r.votes) for r in got}) == 2
