"""The registered query of each operator, and DuckDB SQL where it can express one."""

from __future__ import annotations

from .ann import op5_ann
from .bpe import op8_bpe
from .codes import OP13_SQL, op13_codes
from .conversations import OP12_SQL, op12_conversations
from .html import op9_html
from .language import op11_language
from .neardup import op2_neardup
from .packing import op3_packing
from .sharding import op6_sharding
from .substrings import op10_substrings
from .tokenfiles import op7_tokenfiles
from .topk import OP1_SQL, op1_topk
from .toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_topk, op2_neardup, op3_packing, op4_toxicity, op5_ann, op6_sharding, op7_tokenfiles, op8_bpe, op9_html, op10_substrings, op11_language, op12_conversations, op13_codes)}
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP2_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents
), t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, w, len(w) AS n FROM d
), f AS (
  SELECT doc_id, i, word, i + 19 <= n AND rank() OVER (PARTITION BY CASE WHEN i + 19 <= n THEN array_to_string(w[i:i + 19], ' ') END ORDER BY doc_id, i) > 1 AS again FROM t
), c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f
), r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
SQL = {"op1_topk": OP1_SQL, "op2_neardup": OP2_SQL, "op10_substrings": OP10_SQL, "op12_conversations": OP12_SQL, "op13_codes": OP13_SQL}
