"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_source_mix", r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  coalesce('s' || source, '-') AS k, md5(coalesce(CAST(doc_id AS VARCHAR), '-')) AS tie FROM documents),
s AS (SELECT k, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY k),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - (sum(cap) OVER o - cap) AS spare, sum(weight) OVER () - (sum(weight) OVER o - weight) AS rest
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT *, spare / rest AS lvl, cap <= weight * (spare / rest) AS capped FROM f),
t AS (SELECT k, source_size, n, CASE WHEN capped THEN cap ELSE weight * (max(lvl) FILTER (WHERE NOT capped) OVER ()) END AS target,
             CAST('0x' || substr(md5(k || '|7'), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS u FROM g),
r AS (SELECT d.*, row_number() OVER (PARTITION BY k ORDER BY size, tie) - 1 AS rk FROM d),
p AS (SELECT r.*, t.source_size, t.target, t.u, CASE WHEN rk % 2 = 0 THEN rk // 2 ELSE n - 1 - (rk - 1) // 2 END AS place,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate FROM r JOIN t USING (k)),
c AS (SELECT *, CAST(floor(rate * (place + 1) + u) - floor(rate * place + u) AS BIGINT) AS copies FROM p)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c""")
def source_mix(spark, folder):
    from tidewright.llm.mixing import mix, word_count
    rows = table(spark, folder, "documents").select("doc_id", "source", word_count("text").alias("size"))
    return mix(rows).select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
                            (F.col("_copies") * F.col("size")).alias("taken"), F.col("_copies").alias("copies"))


@query("op2_html_text")
def html_text(spark, folder):
    from tidewright.llm.html_text import extract
    return extract(table(spark, folder, "pages"), ["page_id", "url"])


@query("op3_winnowing")
def winnowing(spark, folder):
    from tidewright.llm.winnowing import fingerprints
    return fingerprints(table(spark, folder, "documents"))


@query("op4_nbest_pieces")
def nbest_pieces(spark, folder):
    from tidewright.llm.nbest import nbest_digests
    return nbest_digests(table(spark, folder, "documents"), cache=600_000)


@query("op5_ordinal_quality")
def ordinal_quality(spark, folder):
    from tidewright.llm.ordinal import fit, quality_grades, score
    docs = table(spark, folder, "documents")
    return score(docs, fit(docs, quality_grades(table(spark, folder, "labels"))), ["doc_id"])


@query("op6_norm_buckets", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5""")
def norm_buckets(spark, folder):
    from tidewright.llm.norm_search import top_k
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op7_jaccard_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
              ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, coalesce(k.k, 0) AS n_links FROM w LEFT JOIN n USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY 1) m USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS k FROM l GROUP BY 1) k USING (doc_id)""")
def jaccard_join(spark, folder):
    from tidewright.llm.jaccard_join import jaccard_components
    return jaccard_components(table(spark, folder, "documents"))


@query("op8_extendible_shards", r"""
WITH RECURSIVE d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 15) AS BIGINT) AS h
                     FROM documents),
b AS (SELECT 0 AS depth, h >> 60 AS prefix, n_bytes, doc_id, h, sum(n_bytes) OVER () AS shard_bytes, count(*) OVER () AS shard_docs, min(h) OVER () AS lo, max(h) OVER () AS hi FROM d
      UNION ALL
      SELECT depth + 1, h >> (59 - depth), n_bytes, doc_id, h, sum(n_bytes) OVER w, count(*) OVER w, min(h) OVER w, max(h) OVER w
      FROM b WHERE shard_bytes > 16777216 AND lo < hi WINDOW w AS (PARTITION BY h >> (59 - depth)))
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '*' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs FROM b WHERE NOT (shard_bytes > 16777216 AND lo < hi)""")
def extendible_shards(spark, folder):
    from tidewright.llm.sharding import shard
    return shard(table(spark, folder, "documents"))


@query("op9_token_files")
def token_files(spark, folder):
    from tidewright.llm.token_files import token_round_trip
    return token_round_trip(table(spark, folder, "documents"))


@query("op10_licence_scan")
def licence_scan(spark, folder):
    from tidewright.llm.licences import scan
    return scan(table(spark, folder, "documents"))


@query("op13_merkle_manifest", r"""
WITH RECURSIVE e AS (SELECT doc_id, coalesce('s' || source, '-') AS k,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) % 5 = 0 AS touched FROM documents),
l AS (SELECT doc_id, k, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
             sha256(head || CASE WHEN text IS NULL THEN '-' WHEN touched THEN strlen(small) || ':' || small ELSE strlen(text) || ':' || text END) AS claimed FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n,
             row_number() OVER (ORDER BY k, doc_id NULLS FIRST, leaf) AS id FROM l),
t AS (SELECT 0 AS lvl, k, pos, n, leaf AS h FROM r
      UNION ALL SELECT lvl + 1, k, pos // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lvl, k, pos // 16),
g AS (SELECT k, h AS subroot, lvl AS top, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM g
      UNION ALL SELECT lvl + 1, pos // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 16),
f AS (SELECT id, k, 0 AS lvl, pos, n, claimed AS own, '' AS proof FROM r
      UNION ALL SELECT f.id, any_value(f.k), f.lvl + 1, any_value(f.pos // 16), any_value((f.n + 15) // 16),
                       sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.own ELSE t.h END, '' ORDER BY t.pos)),
                       any_value(f.proof) || coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos <> f.pos), '')
                FROM f JOIN t ON t.lvl = f.lvl AND t.k = f.k AND t.pos // 16 = f.pos // 16 WHERE f.n > 1 GROUP BY f.id, f.lvl),
v AS (SELECT f.id, 0 AS lvl, g.pos, g.n, f.own, f.proof FROM f JOIN g ON g.k = f.k WHERE f.n = 1
      UNION ALL SELECT v.id, v.lvl + 1, any_value(v.pos // 16), any_value((v.n + 15) // 16),
                       sha256(string_agg(CASE WHEN u.pos = v.pos THEN v.own ELSE u.h END, '' ORDER BY u.pos)),
                       any_value(v.proof) || coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (WHERE u.pos <> v.pos), '')
                FROM v JOIN u ON u.lvl = v.lvl AND u.pos // 16 = v.pos // 16 WHERE v.n > 1 GROUP BY v.id, v.lvl)
SELECT r.doc_id, r.leaf, g.subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(v.proof) AS proof_sha256, v.own AS folded_root, v.own = (SELECT h FROM u WHERE n = 1) AS verified
FROM r JOIN g USING (k) JOIN v ON v.id = r.id AND v.n = 1""")
def merkle_manifest(spark, folder):
    from tidewright.llm.merkle import tamper_proof
    return tamper_proof(table(spark, folder, "documents"))


@query("op12_wu_manber", r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda p: array_to_string(ws[p:p + n - 1], ' '))) AS s FROM
        (SELECT *, least(len(ws), 10) AS n FROM i WHERE len(ws) > 0)),
x AS (SELECT r, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda p: {'p': p, 's': array_to_string(ws[p:p + n - 1], ' ')})) AS o FROM w, (SELECT DISTINCT n FROM g) WHERE len(ws) >= n),
m AS (SELECT x.r, x.n, x.o.p AS p, g.id FROM x JOIN g ON g.n = x.n AND g.s = x.o.s),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (r) LEFT JOIN k USING (r)""")
def wu_manber(spark, folder):
    from tidewright.llm.wu_manber import contamination
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op11_source_divergence", r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT lang, source, r, unnest(ws) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY 1, 2, 3),
k AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS all_n FROM c GROUP BY 1, 2 HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS terms, CAST(sum(all_n) AS BIGINT) AS all_total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.all_n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY lang, source) AS BIGINT) AS total FROM n),
p AS (SELECT s.*, 1 + (1000000000::HUGEINT * (n + 1)) // (total + terms) AS p, 1 + (1000000000::HUGEINT * (all_n + 1)) // (all_total + terms) AS q FROM s JOIN v USING (lang)),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
y AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, 'pair' AS part, item, value FROM y UNION ALL
      SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM z)
SELECT * FROM o WHERE part = 'pair' OR rank <= 200""")
def source_divergence(spark, folder):
    from tidewright.llm.divergence import audit
    return audit(table(spark, folder, "documents"))
