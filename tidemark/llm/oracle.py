"""The same results as DuckDB SQL, where SQL can say them at the tables' size."""

from __future__ import annotations

from tidemark.llm import decontaminate
from tidemark.llm.quality import RULES, STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS + [w.capitalize() for w in STOP_WORDS]))


def _broken() -> str:
    out = []
    for r in RULES:
        m = r.measure.replace("greatest(n_words, 1)", "greatest(n_words, 1)::DOUBLE").replace("greatest(n_lines, 1)", "greatest(n_lines, 1)::DOUBLE")
        test = " OR ".join([f"{m} < {r.low}"] * (r.low is not None) + [f"{m} > {r.high}"] * (r.high is not None))
        out.append(f"CASE WHEN {test} THEN '{r.name}' END")
    return f"list_filter([{', '.join(out)}], lambda x: x IS NOT NULL)"


OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM g) u) v),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE n > 1) x GROUP BY doc_id),
m AS (SELECT g.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(w, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words, len(lines)::BIGINT AS n_lines, len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*(?:[-*]|•)')))::BIGINT AS n_bullet_lines, len(list_filter(lines, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09\r]*$')))::BIGINT AS n_ellipsis_lines FROM g LEFT JOIN hit ON hit.doc_id = g.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_broken()} AS b FROM m)
SELECT * EXCLUDE (b), NOT base_failed AND len(b) = 0 AS kept, coalesce(array_to_string(b, ','), '') AS broken_rules FROM v"""

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_N, _SLOP = decontaminate.N, decontaminate.SLOP
OP2 = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[s : s + {_N - 1}], ' ') AS x, least(len(w), {_N}) AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {_N - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0) u),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win) ks) u),
found AS (SELECT doc_id, s, place.k, place.x FROM place SEMI JOIN win ON place.x = win.x AND place.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM found) x GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS l FROM found JOIN win ON found.x = win.x AND found.k = win.k GROUP BY doc_id),
occ AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM d),
freq AS (SELECT t, count(*) AS n FROM occ GROUP BY t),
term AS (SELECT x, unnest(string_split(x, ' ')) AS t, unnest(range(k)) AS o FROM (SELECT DISTINCT x, k FROM win WHERE k = {_N}) u),
rare AS (SELECT x, arg_min(t, (coalesce(n, 0), t, o)) AS t, arg_min(o, (coalesce(n, 0), t, o)) AS o FROM term LEFT JOIN freq USING (t) GROUP BY x),
cand AS (SELECT DISTINCT doc_id, x, s FROM (SELECT doc_id, x, p - o - unnest(range({_SLOP + 1})) AS s FROM occ JOIN rare USING (t)) u WHERE s >= 0),
near AS (SELECT DISTINCT doc_id, x FROM cand JOIN d USING (doc_id) WHERE len(list_filter(range({_N}), lambda o: list_contains(w[s + o + 1 : s + o + {_SLOP + 1}], string_split(x, ' ')[o + 1]))) = {_N}),
n_near AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM (SELECT doc_id, x FROM near UNION SELECT doc_id, x FROM found) u JOIN win USING (x) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(len(l), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated, coalesce(n_near.n, 0)::BIGINT AS n_near FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id LEFT JOIN n_near ON n_near.doc_id = d.doc_id"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM q"""

ORACLE = {"op2_decontamination": OP2, "op3_quality_rules": OP3, "op9_warc": OP9}
