"""The registered queries of the training-data operators."""

from __future__ import annotations

from wickwork.llm.backoff_model import op11_backoff_scores
from wickwork.llm.decontamination import op2_decontamination
from wickwork.llm.embedding_dedup import op9_embedding_dedup
from wickwork.llm.language_id import op5_language_id
from wickwork.llm.merkle_manifest import op12_merkle_manifest
from wickwork.llm.mixing import op6_mixing
from wickwork.llm.periodic_runs import op13_periodic_runs
from wickwork.llm.pii import op4_pii
from wickwork.llm.quality import op1_quality
from wickwork.llm.simhash_dedup import op7_simhash_dedup
from wickwork.llm.substring_dedup import op3_substring_dedup
from wickwork.llm.token_counts import op10_token_counts
from wickwork.llm.toxicity import op8_toxicity

FOUND = (
    op1_quality, op2_decontamination, op3_substring_dedup, op4_pii, op5_language_id, op6_mixing, op7_simhash_dedup,
    op8_toxicity, op9_embedding_dedup, op10_token_counts, op11_backoff_scores, op12_merkle_manifest, op13_periodic_runs,
)


def queries() -> dict:
    return {f.__name__: f for f in FOUND}


#: Windows of 20 words in order; all but the first of equal ones cover words that go.
SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
x AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + 19], ' ') ORDER BY doc_id, s) AS nth FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM x WHERE nth > 1),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
r AS (SELECT t.doc_id, count(g.i) AS n_removed, coalesce(string_agg(t.word, ' ' ORDER BY t.i) FILTER (g.i IS NULL), '') AS kept FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""

#: All pairs by cosine, and the smallest id over chains of links.
EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
c AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT a, min(b) AS b FROM c GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m.b, vec_id)) AS kept FROM embeddings e LEFT JOIN m ON m.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


#: Targets by filling the sources in order of size over weight; seats by ranking every quotient.
MIXING = r"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS o FROM z GROUP BY source),
s1 AS (SELECT *, CASE (o - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS w, 2.0::DOUBLE * n AS cap, 1.5::DOUBLE * sum(n) OVER () AS total, greatest(65536.0::DOUBLE, sum(n) OVER () / 20000.0) AS shard_words FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY cap / w, o) AS k, coalesce(sum(cap) OVER (ORDER BY cap / w, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (ORDER BY cap / w, o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s1),
s3 AS (SELECT coalesce(min(k) FILTER ((total - before) * w / open < cap), 1000000000) AS k0 FROM s2),
s4 AS (SELECT source, n, o, total, CASE WHEN k < k0 THEN cap ELSE (SELECT (total - before) * 1.0 FROM s2 WHERE k = k0) * w / (SELECT open FROM s2 WHERE k = k0) END AS target, greatest(1, round_even(n / shard_words, 0)::BIGINT) AS shards FROM s2, s3),
s5 AS (SELECT least(64, greatest(1, floor(min(target) / 16)))::BIGINT AS blk FROM s4 WHERE target > 0),
q AS (SELECT source, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, o) AS nth, total FROM s4, LATERAL (SELECT unnest(range(0, 2 * n // (SELECT blk FROM s5))) AS i) WHERE target > 0),
b AS (SELECT source, count(*) FILTER (nth <= floor(total)::BIGINT // (SELECT blk FROM s5)) AS seats FROM q GROUP BY source),
d AS (SELECT z.doc_id, z.source, z.size, n AS source_size, target, md5(concat_ws('|', '20240607', z.doc_id)) AS h, ('0x' || substr(md5(concat_ws('|', '20240608', z.doc_id)), 1, 8))::BIGINT % shards AS shard FROM z JOIN s4 ON z.source IS NOT DISTINCT FROM s4.source),
e AS (SELECT *, (sum(size) OVER (PARTITION BY source, shard ORDER BY h NULLS FIRST, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM d),
h AS (SELECT source, shard, sum(size)::BIGINT AS m FROM d GROUP BY ALL),
r AS (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY m / (2 * i + 1.0::DOUBLE) DESC, shard) AS nth FROM h, LATERAL (SELECT unnest(range(0, 2 * m // (SELECT blk FROM s5))) AS i)),
g AS (SELECT r.source, shard, count(*) FILTER (nth <= coalesce(seats, 0)) * (SELECT blk FROM s5) AS quota FROM r LEFT JOIN b ON r.source IS NOT DISTINCT FROM b.source GROUP BY ALL),
f AS (SELECT e.*, m, stop - size AS start, CASE WHEN m > 0 THEN coalesce(quota, 0) // m ELSE 0 END AS passes, CASE WHEN m > 0 THEN coalesce(quota, 0) % m ELSE 0 END AS rest,
  ('0x' || substr(md5(concat_ws('|', '20240609', e.source, e.shard)), 1, 8))::BIGINT % greatest(1, ceil(m / (SELECT blk FROM s5)::DOUBLE)::BIGINT) * (SELECT blk FROM s5) AS a
  FROM e JOIN h ON e.source IS NOT DISTINCT FROM h.source AND e.shard = h.shard LEFT JOIN g ON e.source IS NOT DISTINCT FROM g.source AND e.shard = g.shard)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(stop, a + rest) - greatest(start, a)) + greatest(0, least(stop, a + rest - m) - start))::BIGINT AS taken FROM f
"""

#: Trees level by level; the way of each leaf is folded one step after the other.
MERKLE_MANIFEST = r"""
WITH RECURSIVE d AS (SELECT *, row_number() OVER () AS rid,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a, coalesce(strlen(text) || ':' || text, '-') AS z,
  (4294967295 - list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]))), lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, (r & 1) * 3988292384) END)) % 7 = 0 AS hit FROM documents),
l0 AS (SELECT rid, doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf, CASE WHEN hit THEN sha256(a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || z) END AS bad FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l0),
t AS (SELECT lang, 0 AS level, i, leaf AS node, n FROM l UNION ALL SELECT lang, level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, level, i // 2, n),
s AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS nth, count(*) OVER () AS trees FROM t WHERE n = 1),
u AS (SELECT 0 AS level, nth AS i, subroot AS node, trees AS n FROM s UNION ALL SELECT level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, i // 2, n),
h AS (SELECT lang, max(level) AS top FROM t GROUP BY lang),
w AS (SELECT l.rid, t.level AS k, l.i >> t.level & 1 = 1 AS odd, o.node AS other FROM l JOIN t ON l.lang IS NOT DISTINCT FROM t.lang AND t.i = l.i >> t.level AND t.n > 1 LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM t.lang AND o.level = t.level AND o.i = xor(t.i, 1)
  UNION ALL SELECT l.rid, top + u.level, s.nth >> u.level & 1 = 1, o.node FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang JOIN h ON l.lang IS NOT DISTINCT FROM h.lang JOIN u ON u.i = s.nth >> u.level AND u.n > 1 LEFT JOIN u o ON o.level = u.level AND o.i = xor(u.i, 1)),
f AS (SELECT rid, 0 AS k, coalesce(bad, leaf) AS node FROM l UNION ALL SELECT f.rid, f.k + 1, sha256(CASE WHEN other IS NULL THEN node WHEN odd THEN other || node ELSE node || other END) FROM f JOIN w ON w.rid = f.rid AND w.k = f.k),
e AS (SELECT rid, arg_max(node, k) AS folded_root FROM f GROUP BY rid),
p AS (SELECT rid, string_agg(other, '' ORDER BY k) AS proof FROM w GROUP BY rid)
SELECT doc_id, leaf, subroot, (SELECT node FROM u WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = (SELECT node FROM u WHERE n = 1) AS verified FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang JOIN e USING (rid) LEFT JOIN p USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    """The others learn models, hash or permute, which SQL cannot express; tests/llm holds them against brute force."""
    return {"op3_substring_dedup": SUBSTRING_DEDUP, "op6_mixing": MIXING, "op9_embedding_dedup": EMBEDDING_DEDUP, "op12_merkle_manifest": MERKLE_MANIFEST}
