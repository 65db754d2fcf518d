"""SQL of the fuzzy ratios, so that queries with them have a twin: common subsequences by a recursive table."""

from __future__ import annotations


def lcs_sql(pairs: str) -> str:
    """CTE lcs (p, q, n): the length of the longest common subsequence of each pair (p, q) of the named relation."""
    return f"""dp(p, q, j, cells) AS (SELECT p, q, 0, list_transform(range(0, len(p) + 1), lambda i: 0) FROM {pairs}
UNION ALL SELECT p, q, j + 1, list_concat([0], list_transform(range(1, len(p) + 1), lambda i: list_max(c[1:i]))) FROM (SELECT p, q, j, list_transform(range(1, len(p) + 1), lambda i: greatest(cells[i + 1], cells[i] + CASE WHEN p[i] = q[j + 1] THEN 1 ELSE 0 END)) AS c FROM dp WHERE j < len(q))),
lcs AS (SELECT p, q, cells[len(p) + 1] AS n FROM dp WHERE j = len(q))"""


def windows_sql(pairs: str) -> str:
    """CTE win (p, q, w): the windows of the longer text q that p, no longer than it, is compared with."""
    return f"""win AS (SELECT p, q, q[greatest(1, e - len(p) + 1):least(len(q), e)] AS w FROM (SELECT p, q, unnest(range(1, len(p) + len(q))) AS e FROM {pairs}))"""


def weighted_ratio_sql(source: str) -> str:
    """CTEs that end in weighted (a, b, ratio) for the different pairs (a, b) of the named relation; WITH RECURSIVE before them."""
    words = lambda c: f"list_filter(string_split({c}, ' '), lambda x: x <> '')"
    text = lambda c: f"array_to_string({c}, ' ')"
    short = lambda a, b, where: f"SELECT CASE WHEN len({a}) <= len({b}) THEN {a} ELSE {b} END AS p, CASE WHEN len({a}) <= len({b}) THEN {b} ELSE {a} END AS q FROM f4 WHERE {where}"
    ratio = lambda a, b: f"(SELECT 200.0 * n / (len(p) + len(q)) FROM lcs WHERE p = {a} AND q = {b})"
    part = lambda a, b: f"(SELECT best FROM parts WHERE p = CASE WHEN len({a}) <= len({b}) THEN {a} ELSE {b} END AND q = CASE WHEN len({a}) <= len({b}) THEN {b} ELSE {a} END)"
    return f"""f1 AS (SELECT DISTINCT a, b FROM {source} WHERE a <> '' AND b <> ''),
f2 AS (SELECT a, b, greatest(len(a), len(b)) / CAST(least(len(a), len(b)) AS DOUBLE) AS longer, list_sort(list_distinct({words('a')})) AS sa, list_sort(list_distinct({words('b')})) AS sb, {text(f"list_sort({words('a')})")} AS oa, {text(f"list_sort({words('b')})")} AS ob FROM f1),
f3 AS (SELECT a, b, longer, oa, ob, {text('list_filter(sa, lambda x: list_contains(sb, x))')} AS h, {text('list_filter(sa, lambda x: NOT list_contains(sb, x))')} AS x, {text('list_filter(sb, lambda x: NOT list_contains(sa, x))')} AS y FROM f2),
f4 AS (SELECT *, trim(h || ' ' || x) AS l, trim(h || ' ' || y) AS r FROM f3),
partial_pairs AS ({short('a', 'b', 'longer >= 1.5')} UNION {short('oa', 'ob', "longer >= 1.5 AND h = ''")} UNION {short('x', 'y', "longer >= 1.5 AND h = ''")}),
{windows_sql('partial_pairs')},
lcs_pairs AS (SELECT a AS p, b AS q FROM f4 UNION SELECT oa, ob FROM f4 WHERE longer < 1.5 UNION SELECT l, r FROM f4 WHERE longer < 1.5 UNION SELECT p, w FROM win),
{lcs_sql('lcs_pairs')},
parts AS (SELECT win.p, win.q, max(200.0 * n / (len(win.p) + len(w))) AS best FROM win JOIN lcs ON lcs.p = win.p AND lcs.q = w GROUP BY ALL),
f5 AS (SELECT *, {ratio('a', 'b')} AS whole, CASE WHEN longer < 1.5 THEN CASE WHEN h <> '' AND (x = '' OR y = '') THEN 100.0 ELSE greatest({ratio('oa', 'ob')}, {ratio('l', 'r')}, CASE WHEN h <> '' THEN 200.0 * len(h) / (len(h) + least(len(l), len(r))) ELSE 0 END) END END AS token,
CASE WHEN longer >= 1.5 THEN {part('a', 'b')} END AS window_best, CASE WHEN longer >= 1.5 THEN CASE WHEN h <> '' THEN 100.0 ELSE greatest({part('oa', 'ob')}, {part('x', 'y')}) END END AS window_token, CASE WHEN longer < 8 THEN 0.9 ELSE 0.6 END AS scale FROM f4),
weighted AS (SELECT a, b, CASE WHEN longer < 1.5 THEN greatest(whole, 0.95 * token) ELSE greatest(whole, scale * window_best, 0.95 * scale * window_token) END AS ratio FROM f5)"""


def partial_ratio_sql(source: str) -> str:
    """CTEs that end in partials (a, b, ratio) for the different pairs (a, b) of the named relation; WITH RECURSIVE before them."""
    return f"""g1 AS (SELECT DISTINCT a, b, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS p, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS q FROM {source} WHERE a <> '' AND b <> ''),
g2 AS (SELECT DISTINCT p, q FROM g1), {windows_sql('g2')}, lcs_pairs AS (SELECT DISTINCT p, w AS q FROM win), {lcs_sql('lcs_pairs')},
partials AS (SELECT a, b, max(200.0 * n / (len(win.p) + len(w))) AS ratio FROM g1 JOIN win ON win.p = g1.p AND win.q = g1.q JOIN lcs ON lcs.p = win.p AND lcs.q = w GROUP BY ALL)"""
