"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_CANONICAL = "regexp_replace(host, '^(?:www|m)\\.', '') || regexp_replace(path, '(?:/|\\.html)$', '')"
_FITS = "((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}'))"


def urls(rules: tuple[tuple[str, str], ...]) -> str:
    fits = " ".join(f"WHEN {_FITS.format(h=t.partition('/')[0], p=t.partition('/')[2])} THEN '{t}'" for t, _ in sorted(rules, key=lambda r: -len(r[0])))
    verdicts = " ".join(f"WHEN rule = '{t}' THEN '{v}'" for t, v in rules)
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS mark FROM pages),
parts AS (SELECT page_id, url, CASE WHEN mark > 0 THEN translate(regexp_extract(substr(url, mark + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN mark > 0 THEN regexp_extract(substr(url, mark + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
ruled AS (SELECT *, CASE {fits} END AS rule, {_CANONICAL} AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM ruled WHERE regexp_matches(url, '[?&]ref=') AND canonical <> '')
SELECT page_id, host, path, rule, CASE {verdicts} WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict, canonical FROM ruled
"""


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


def _shingles(source: str, key: str) -> str:
    """key, distinct 5-word shingles of lower-cased runs of letters and digits; of fewer words, none."""
    return f"""(SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [] END) AS s
  FROM (SELECT {key}, {_WORDS} AS w FROM {source}))"""


#: Items of fewer than five words are in every document that has these words in a row.
LEAKS = f"""
WITH d AS {_shingles("documents", "doc_id")}, i AS {_shingles("benchmark", "item_id")}, n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY 1),
few AS (SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS run FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) BETWEEN 1 AND 4)
SELECT doc_id, item_id, n_item, n_shared FROM (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY 1, 2) JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
UNION ALL SELECT doc_id, item_id, 1, 1 FROM (SELECT doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS whole FROM documents WHERE EXISTS (SELECT * FROM few)) JOIN few ON contains(whole, run)
"""

NEAR_DUPLICATES = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT s, count(*) AS f FROM s GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT s.doc_id, s.s, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(f.f, 1), s.s) AS rank FROM s JOIN n USING (doc_id) LEFT JOIN f USING (s)),
p AS (SELECT * FROM r WHERE rank <= n - ceil(n * 0.8) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.s = b.s AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
e AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.s = y.s GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, g.b FROM reach JOIN g ON reach.node = g.a),
least AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY 1)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""
