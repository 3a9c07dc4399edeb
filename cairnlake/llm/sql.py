"""DuckDB SQL for the queries that SQL can express, by plain joins rather than by the operators' methods."""

_CUT = "[.,;:!?dgmpyz] "
_LEAVES = (
    "list_transform(string_split({t}, chr(10)), lambda p: list_transform(list_concat(regexp_extract_all(p, '.*?"
    + _CUT
    + "|.+$'), CASE WHEN p = '' OR regexp_matches(p, '"
    + _CUT
    + "$') THEN [''] ELSE [] END), lambda x: substr(sha256(x), 1, 32)))"
)
_LABELS = "list_sort(list_distinct(list_transform(flatten({v}), lambda x: substr(x, 1, 12))))[1:64]"
_PARAGRAPHS = "list_transform({v}, lambda p: substr(sha256('p' || array_to_string(p, '')), 1, 32))"
_ENDS = "list_filter(range(1, len({n}) + 1), lambda i: i = len({n}) OR regexp_matches({n}[i], '^[01]'))"
_ROOT = "sha256('r' || array_to_string(list_transform(range(1, len({e}) + 1), lambda j: substr(sha256('s' || array_to_string({n}[CASE WHEN j > 1 THEN {e}[j - 1] ELSE 0 END + 1 : {e}[j]], '')), 1, 32)), ''))"
_BOTH = "list_sort(list_distinct(list_concat({a}, {b})))"
_HOLD = "CASE WHEN len({a}) < 64 AND len({b}) < 64 THEN len({u}) ELSE least(len({u}), 64) END"
_NEAR = "2.0::DOUBLE * len(list_intersect({u}[1:{n}], list_intersect({a}, {b}))) / ({n} + len(list_intersect({u}[1:{n}], list_intersect({a}, {b}))))"
_HEAD = "coalesce(list_position(list_transform(range(1, greatest(len({a}), len({b})) + 1), lambda i: {a}[i] IS DISTINCT FROM {b}[i]), true) - 1, len({a}))"

MERKLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first(t) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nx FROM d),
e AS (SELECT doc_id, t, nx, length(t)::BIGINT AS n_chars, substr(t, 1, length(t) - length(t) // 2) || substr(nx, 1, length(t) // 2) AS ed FROM n),
v AS (SELECT *, {_LEAVES.format(t="t")} AS lt, {_LEAVES.format(t="ed")} AS le, {_LEAVES.format(t="nx")} AS ln FROM e),
p AS (SELECT *, {_PARAGRAPHS.format(v="lt")} AS pt, {_PARAGRAPHS.format(v="le")} AS pe, {_LABELS.format(v="lt")} AS a, {_LABELS.format(v="le")} AS b, {_LABELS.format(v="ln")} AS c FROM v),
s AS (SELECT *, {_ENDS.format(n="pt")} AS et, {_ENDS.format(n="pe")} AS ee, {_BOTH.format(a="a", b="b")} AS ab, {_BOTH.format(a="a", b="c")} AS ac, {_HEAD.format(a="pt", b="pe")} AS h, {_HEAD.format(a="list_reverse(pt)", b="list_reverse(pe)")} AS r FROM p),
q AS (SELECT *, {_HOLD.format(a="a", b="b", u="ab")} AS nb, {_HOLD.format(a="a", b="c", u="ac")} AS nc, least(r, least(len(pt), len(pe)) - h) AS z, coalesce(lt[h + 1], []) AS x, coalesce(le[h + 1], []) AS y FROM s)
SELECT doc_id, n_chars, sha256(ed) AS edited_sha256, {_ROOT.format(n="pt", e="et")} || ':' || array_to_string(a, '') AS fingerprint, {_ROOT.format(n="pe", e="ee")} || ':' || array_to_string(b, '') AS edited_fingerprint,
 {_NEAR.format(a="a", b="b", u="ab", n="nb")} AS near_edited, {_NEAR.format(a="a", b="c", u="ac", n="nc")} AS near_next,
 CASE WHEN t <> ed THEN h END::INT AS edit_first, CASE WHEN t <> ed THEN len(pt) - z END::INT AS edit_last, CASE WHEN t <> ed THEN len(pe) - z END::INT AS edit_other_last,
 CASE WHEN t <> ed THEN {_HEAD.format(a="x", b="y")} END::INT AS edit_piece FROM q
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT links.b, r.c FROM r JOIN links ON links.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)
"""

LINES = """
WITH RECURSIVE o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS k FROM documents),
occ AS (SELECT *, length(line) AS n FROM o WHERE length(line) >= 24),
u AS (SELECT DISTINCT line, n, n // 2 AS h FROM occ),
near AS (SELECT a.line AS a, b.line AS b FROM u a JOIN u b ON substr(a.line, 1, a.h) = substr(b.line, 1, a.h) AND b.n BETWEEN a.n AND a.n + 1 AND a.line <> b.line
 UNION SELECT a.line, b.line FROM u a JOIN u b ON right(a.line, a.h) = right(b.line, a.h) AND b.n BETWEEN a.n AND a.n + 1 AND a.line <> b.line),
half AS (SELECT a, b FROM near WHERE levenshtein(a, b) <= 1),
links AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
degree AS (SELECT a AS line, count(*) AS n_links FROM links GROUP BY 1),
r(line, c) AS (SELECT a, a FROM links UNION SELECT links.b, r.c FROM r JOIN links ON links.a = r.line),
root AS (SELECT line, min(c) AS c FROM r GROUP BY 1),
named AS (SELECT occ.*, coalesce(root.c, occ.line) AS c, coalesce(n_links, 0) AS n_links FROM occ LEFT JOIN root USING (line) LEFT JOIN degree USING (line)),
class AS (SELECT c, count(*) AS total, min((doc_id, k)) AS head FROM named GROUP BY 1),
hit AS (SELECT doc_id, k, n, n_links, struct_extract_at(head, 1) AS hd, struct_extract_at(head, 2) AS hk, total > 1 AND (doc_id, k) <> head AS goes FROM named JOIN class USING (c)),
per AS (SELECT doc_id, sum(n_links)::BIGINT AS n_links, coalesce(count(*) FILTER (goes), 0) AS m, coalesce(string_agg(k || ':' || hd || ':' || hk, ',' ORDER BY k) FILTER (goes), '') AS repeated, coalesce(list(k) FILTER (goes), []) AS gone FROM hit GROUP BY 1),
j AS (SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS p, coalesce(n_links, 0) AS n_links, coalesce(repeated, '') AS repeated, gone, m, coalesce(m > 0, false) AS goes FROM documents d LEFT JOIN per USING (doc_id))
SELECT doc_id, CASE WHEN goes THEN array_to_string(list_transform(list_filter(range(0, len(p)), lambda i: NOT list_contains(gone, i::INT)), lambda i: p[i + 1]), chr(10)) ELSE text END AS text,
 coalesce(len(p), 0)::BIGINT AS n_lines, CASE WHEN goes THEN m ELSE 0 END::BIGINT AS n_removed, n_links::BIGINT AS n_links, repeated FROM j
"""
