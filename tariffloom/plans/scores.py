"""The scores of short texts in DuckDB SQL, by longest common subsequences, to compare queries with."""

from __future__ import annotations


def subsequence(x: str, y: str) -> str:
    """The length of the longest common subsequence: a row of it for each letter of x, from the one before."""
    equal = f"list_transform(string_split({x}, ''), lambda c: list_transform(string_split({y}, ''), lambda d: CASE WHEN c = d THEN 1 ELSE 0 END))"
    reach = "list_transform(range(1, len(e) + 1), lambda k: greatest(r[k], coalesce(r[k - 1], 0) + e[k]))"
    row = f"list_transform(range(1, len(e) + 1), lambda j: list_max(({reach})[1:j]))"
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0 ELSE list_last(list_reduce(list_prepend(list_transform(string_split({y}, ''), lambda d: 0), {equal}), lambda r, e: {row})) END"


def ctes(pairs: str, always_parts: bool = False) -> str:
    """CTEs that give scored (a, b, token_set, part, weighted) of the distinct pairs (a, b) of a CTE. Texts have single blanks."""
    words = lambda c: f"string_split({c}, ' ')"
    text = lambda c: f"array_to_string(list_sort({c}), ' ')"
    far = "TRUE" if always_parts else "1.0 * greatest(length(a), length(b)) / least(length(a), length(b)) >= 1.5"
    return f"""sc_w AS MATERIALIZED (
  SELECT a, b, {text(f"list_intersect({words('a')}, {words('b')})")} AS sh, {text(f"list_filter(list_distinct({words('a')}), lambda x: NOT list_contains({words('b')}, x))")} AS le,
    {text(f"list_filter(list_distinct({words('b')}), lambda x: NOT list_contains({words('a')}, x))")} AS ri, {text(words('a'))} AS sa, {text(words('b'))} AS sb, {far} AS far
  FROM (SELECT DISTINCT a, b FROM {pairs})
), sc_t AS (SELECT *, trim(sh || ' ' || le) AS one, trim(sh || ' ' || ri) AS two FROM sc_w
), sc_need AS (
  SELECT a AS x, b AS y FROM sc_w WHERE far UNION SELECT sa, sb FROM sc_w WHERE far AND sh = '' UNION SELECT le, ri FROM sc_w WHERE far AND sh = ''
), sc_side AS (
  SELECT x, y, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS l FROM sc_need
  UNION SELECT x, y, y, x FROM sc_need WHERE length(x) = length(y)
), sc_ends AS (SELECT x, y, s, l, unnest(range(1, greatest(length(l) + length(s), 2))) AS e FROM sc_side
), sc_win AS (SELECT DISTINCT x, y, s, l[greatest(0, e - length(s)) + 1:least(e, length(l))] AS w FROM sc_ends
), sc_lc AS MATERIALIZED (
  SELECT x, y, {subsequence('x', 'y')} AS n FROM (SELECT s AS x, w AS y FROM sc_win UNION SELECT a, b FROM sc_w UNION SELECT sa, sb FROM sc_w UNION SELECT one, two FROM sc_t)
), sc_ratio AS MATERIALIZED (SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN 100.0 ELSE 200.0 * n / (length(x) + length(y)) END AS r FROM sc_lc
), sc_part AS MATERIALIZED (
  SELECT k.x, k.y, max(CASE WHEN s = '' THEN CASE WHEN l = '' THEN 100.0 ELSE 0.0 END WHEN w = '' THEN 0.0 ELSE r END) AS p FROM sc_win k JOIN sc_side USING (x, y, s) JOIN sc_ratio q ON q.x = k.s AND q.y = k.w GROUP BY k.x, k.y
), sc_set AS (
  SELECT t.*, CASE WHEN trim(a) = '' OR trim(b) = '' THEN 0.0 WHEN sh <> '' AND (le = '' OR ri = '') THEN 100.0
    ELSE greatest(r, CASE WHEN sh <> '' THEN 200.0 * length(sh) / (length(sh) + length(one)) ELSE 0 END, CASE WHEN sh <> '' THEN 200.0 * length(sh) / (length(sh) + length(two)) ELSE 0 END) END AS token_set
  FROM sc_t t JOIN sc_ratio q ON q.x = one AND q.y = two
), scored AS MATERIALIZED (
  SELECT s.a, s.b, token_set, coalesce(p.p, 0) AS part, CASE WHEN s.a = '' OR s.b = '' THEN 0.0 WHEN NOT far OR 1.0 * greatest(length(s.a), length(s.b)) / least(length(s.a), length(s.b)) < 1.5 THEN greatest(w.r, 0.95 * greatest(k.r, token_set))
    ELSE greatest(w.r, CASE WHEN greatest(length(s.a), length(s.b)) <= 8 * least(length(s.a), length(s.b)) THEN 0.9 ELSE 0.6 END * greatest(p.p, 0.95 * CASE WHEN sh <> '' THEN 100.0 ELSE greatest(o.p, d.p) END)) END AS weighted
  FROM sc_set s JOIN sc_ratio w ON w.x = s.a AND w.y = s.b JOIN sc_ratio k ON k.x = sa AND k.y = sb
  LEFT JOIN sc_part p ON p.x = s.a AND p.y = s.b LEFT JOIN sc_part o ON o.x = sa AND o.y = sb LEFT JOIN sc_part d ON d.x = le AND d.y = ri
)"""
