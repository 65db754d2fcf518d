"""Registered queries over text fields and keys, edited filter lists and the rerank of candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import parse, text
from lotwise.operators import filters, matching
from lotwise.operators.filters import Filter
from lotwise.plans.market import query
from lotwise.plans.ratio_sql import weighted_ratio_sql
from lotwise.plans.texts import RULES_J, STD, pairs
from lotwise.sources import views as v


@query("SELECT p_partkey, 'château ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' o c' ELSE '' END AS title FROM part")
def i2_plain_title(s, d):
    """Titles without closing bracket, year and punctuation; accents stay."""
    c = F.concat(F.lit("  Château, "), F.initcap("p_name"), F.when(F.col("p_size") % 2 == 0, " (o) c 1998").otherwise(" 1998 (OWC, 12 bt) "))
    return v.read(s, d, "part").select("p_partkey", text.plain_title(c).alias("title"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_brand ELSE p_brand || ' ' || p_type END AS merged FROM part")
def i6_merged_text(s, d):
    """Fields in one text; null and empty ones leave no gap."""
    k = F.col("p_size") % 3
    p = v.read(s, d, "part").select("p_partkey", F.when(k < 2, F.col("p_name")).alias("a"), F.when(k == 0, "").otherwise(F.col("p_brand")).alias("b"), F.when(k == 2, F.col("p_type")).alias("c"))
    return p.select("p_partkey", text.merged("a", "b", "c").alias("merged"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 700 < 601 THEN (1500 + p_partkey % 700) || CASE WHEN p_partkey % 700 < 500 THEN ',2000' ELSE '' END ELSE '2000' END AS years FROM part")
def j13_wide_years(s, d):
    """Years from 1500 to 2100; other numbers of four digits are none."""
    t = F.concat(F.lit("Madeira "), F.lit(1500) + F.col("p_partkey") % 700, F.when(F.col("p_partkey") % 700 > 500, F.when(F.col("p_partkey") % 700 < 601, "").otherwise(" 2000")).otherwise(", 2000 and 1499, 9999"))
    got = v.read(s, d, "part").select("p_partkey", parse.wide_years(t).alias("y"))
    return got.select("p_partkey", F.array_join(F.col("y").cast("array<string>"), ",").alias("years"))


@query("SELECT l_orderkey || '_' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY ALL")
def i11_composite_key(s, d):
    return v.read(s, d, "lineitem").groupBy(text.composite_key("l_orderkey", "l_linenumber").alias("key")).agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' x' ELSE '' END, ' ') AS w FROM part), g AS (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM w)
SELECT p_partkey, array_to_string(list_sort(list(array_to_string(w[i:i + n - 1], ' '))), '|') AS grams FROM g, (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w) GROUP BY ALL""")
def i18_word_grams(s, d):
    """All runs of one to three words of a title."""
    t = F.concat_ws("  ", "p_name", "p_type", F.when(F.col("p_size") % 2 == 0, "x"))
    return v.read(s, d, "part").select("p_partkey", F.array_join(F.array_sort(text.word_grams(t)), "|").alias("grams"))


@query(v.sql("lots") + " SELECT count(*) AS n, CAST(sum(unit) AS BIGINT) AS units FROM lots WHERE end_price BETWEEN 10000 AND 20000 AND original_currency = 'EUR'")
def b16_edited_filters(s, d):
    """A filter list after its editing: a condition taken out again, a range in place of another."""
    asked = [Filter("end_price", "><", [1, 2]), Filter("sold", "=", True)]
    asked = filters.toggle(filters.toggle(asked, Filter("sold", "=", True)), Filter("original_currency", "=", "EUR"))
    asked = filters.replace_range(asked, Filter("end_price", "><", [10000, 20000]))
    return filters.apply_filters(v.lots(s, d), asked).agg(F.count("*").alias("n"), F.sum("unit").alias("units"))


SECOND = " OR ".join(f"contains(lower({{0}}), '{w.replace(chr(39), chr(39) * 2)}')" for w in matching.SECOND_WINES)
NEAR = "CASE WHEN {c} <> '' AND coalesce((SELECT ratio FROM weighted WHERE a = wn AND b = {s}), 0) >= {least} THEN {gain} ELSE 0 END"


@query(RULES_J + f""", r AS (SELECT j.*, lower(lp) AS pc, CASE WHEN doc % 4 = 0 THEN 'Premier Cru' WHEN doc % 4 = 1 THEN '2eme Cru Classe' ELSE '' END AS label, CASE WHEN doc % 5 = 0 THEN 'Le Carillon ' || cw ELSE cw END AS wine2 FROM j),
pairs_ AS (SELECT lower(pn) AS a, pc AS b FROM r UNION SELECT wn, {STD('csr')} FROM r UNION SELECT wn, {STD('cs')} FROM r), {weighted_ratio_sql('pairs_')},
p AS (SELECT r.*, (SELECT ratio FROM weighted WHERE a = lower(pn) AND b = pc) / 100 AS pr FROM r)
SELECT doc, round(greatest(0, 0.6 + CASE WHEN {SECOND.format('wn')} THEN 0 WHEN label <> '' THEN 0.02 WHEN {SECOND.format('wine2')} THEN -0.02 ELSE 0 END + {NEAR.format(c='csr', s=STD('csr'), least=90, gain=0.04)} + {NEAR.format(c="coalesce(cs, '')", s=STD('cs'), least=80, gain=0.02)}
 + CASE WHEN coalesce(pc, '') = '' THEN 0 WHEN pr >= 0.95 THEN 0.02 WHEN pr < 0.8 THEN -0.05 ELSE 0 END), 4) AS score FROM p""")
def k5_rerank(s, d):
    """Bonuses and deductions for producer, label, second wines, sub-region and site."""
    label = F.when(F.col("doc") % 4 == 0, "Premier Cru").when(F.col("doc") % 4 == 1, "2eme Cru Classe").otherwise("")
    second = F.when(F.col("doc") % 5 == 0, F.concat(F.lit("Le Carillon "), "c_wine")).otherwise(F.col("c_wine"))
    p = pairs(s, d).withColumns({"producer_clean": F.lower("lot_producer"), "c_classification": label, "c_wine": second})
    return p.select("doc", F.round(matching.rerank(F.lit(0.6)), 4).alias("score"))
