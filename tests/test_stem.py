"""The stemmer against its published sample vocabulary, and the ratios of many pairs against those of one."""

import random

import numpy as np
import pytest

from lotwise.functions import fuzzy
from lotwise.functions.stem import stem

SAMPLE = """consign consign, consigned consign, consigning consign, consignment consign, consist consist, consisted consist, consistency consist, consistent consist, consistently consist, consisting consist, consists consist,
consolation consol, consolations consol, consolatory consolatori, console consol, consoled consol, consoles consol, consolidate consolid, consolidated consolid, consolidating consolid, consoling consol, consolingly consol, consols consol,
consonant conson, consort consort, consorted consort, consorting consort, conspicuous conspicu, conspicuously conspicu, conspiracy conspiraci, conspirator conspir, conspirators conspir, conspire conspir, conspired conspir, conspiring conspir,
constable constabl, constables constabl, constance constanc, constancy constanc, constant constant, knack knack, knackeries knackeri, knacks knack, knag knag, knave knave, knaves knave, knavish knavish, kneaded knead, kneading knead,
knee knee, kneel kneel, kneeled kneel, kneeling kneel, kneels kneel, knees knee, knell knell, knelt knelt, knew knew, knick knick, knif knif, knife knife, knight knight, knightly knight, knights knight, knit knit, knits knit, knitted knit,
knitting knit, knives knive, knob knob, knobs knob, knock knock, knocked knock, knocker knocker, knockers knocker, knocking knock, knocks knock, knopp knopp, knot knot, knots knot"""
RULES = """generate generat, general general, communism communism, skies sky, dying die, news news, inning inning, exceed exceed, ties tie, cries cri, gas gas, this this, gaps gap, kiwis kiwi, hopping hop, hoping hope, hoped hope, luxuriating luxuri,
agreed agre, feed feed, by by, say say, happy happi, relational relat, conditional condit, valenci valenc, digitizer digit, operator oper, sensibiliti sensibl, geology geolog, sadly sad, hopeful hope, goodness good, formative format, electrical electr,
adoption adopt, adjustment adjust, controll control, roll roll, rate rate, beautiful beauti, burgundies burgundi, chateaux chateaux, youth youth, boyish boyish, o'brien's o'brien"""


@pytest.mark.parametrize("pairs", [SAMPLE, RULES])
def test_published_stems(pairs):
    want = dict(p.split() for p in pairs.split(","))
    assert {w: stem(w) for w in want} == want


def test_ratios_of_many_pairs():
    rng = random.Random(1)
    words = ["chateau", "margaux", "dom", "de", "la", "romanee", "brand", "13", "é", "x", "pauillac premier grand cru"]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 9))) if rng.random() < 0.8 else "".join(rng.choices("abc d\0", k=rng.randint(0, 90)))
    a, b = [text() for _ in range(600)] + ["", "a", ""], [text() for _ in range(600)] + ["", "", "b"]
    for many, one in ((fuzzy.ratios, fuzzy.ratio), (fuzzy.partial_ratios, fuzzy.partial_ratio), (fuzzy.weighted_ratios, fuzzy.weighted_ratio)):
        assert np.allclose(many(a, b), [one(x, y) for x, y in zip(a, b)], atol=1e-9)
    assert fuzzy.weighted_ratios([None, "a"], ["a", None]).tolist() == [0.0, 0.0] and len(fuzzy.weighted_ratios([], [])) == 0


def test_partial_ratio_sees_every_window():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd ", k=rng.randint(1, 12))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        n = len(short)
        windows = [long[max(0, e - n) : e] for e in range(1, len(long) + n)]
        assert abs(fuzzy.partial_ratio(a, b) - max(fuzzy.ratio(short, w) for w in windows if w)) < 1e-9
