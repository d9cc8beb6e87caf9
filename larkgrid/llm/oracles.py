"""SQL for operators that can be said in SQL but for their method: all strings and all pairs are compared."""

from larkgrid.llm.suffix_dedup import LENGTH, PASSAGE


def _runs(length: int, tag: str) -> str:
    """Tables of all strings of a length, those that occur twice, and the runs (a, e) that these cover."""
    return f"""w{tag} AS (SELECT doc_id, p, md5(b[p + 1:p + {length}]) AS h FROM (SELECT doc_id, b, unnest(range(octet_length(b) - {length - 1})) AS p FROM d WHERE octet_length(b) >= {length})),
r{tag} AS (SELECT doc_id, p FROM w{tag} JOIN (SELECT h FROM w{tag} GROUP BY h HAVING count(*) > 1) USING (h)),
g{tag} AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {length} THEN 0 ELSE 1 END AS fresh FROM r{tag})),
s{tag} AS (SELECT doc_id, min(p) AS a, max(p) + {length} AS e FROM g{tag} GROUP BY doc_id, run)"""


OP4_SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
{_runs(LENGTH, "")},
{_runs(PASSAGE, "_p")},
k AS (SELECT s.doc_id, s.a, s.e, hex(b) AS x, coalesce(lag(s.e) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS f FROM s JOIN d USING (doc_id)),
t AS (SELECT doc_id, sum(e - a) AS gone, count(*) AS n, string_agg(substr(x, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) || substr(any_value(x), 2 * max(e) + 1) AS kept FROM k GROUP BY doc_id),
u AS (SELECT doc_id, CAST(sum(e - a) AS BIGINT) AS passage_bytes, count(*) AS n_passages FROM s_p GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, coalesce(passage_bytes, 0) AS passage_bytes, coalesce(n_passages, 0) AS n_passages,
  sha256(unhex(coalesce(kept, hex(b)))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN u USING (doc_id)
"""

OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3])) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT u.b, reach.c FROM reach JOIN u ON u.a = reach.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
