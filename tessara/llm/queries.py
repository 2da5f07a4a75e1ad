"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats
from .common import table
from .decontamination import scan_documents
from .embedding_dedup import embedding_duplicates
from .html_extraction import extract_text
from .jaccard import near_duplicates
from .language_model import score_texts
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .pii import KINDS, count_kind, find_private, spans_text
from .quality import score_quality


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copy_id", "n_grams")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents"))
    counts = [count_kind(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    scored = score_texts(table(spark, sf_dir, "documents"), fold != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_mixing": op2_mixing,
    "op3_html": op3_html,
    "op4_embeddings": op4_embeddings,
    "op5_jaccard": op5_jaccard,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_language_model": op8_language_model,
    "op9_line_dedup": op9_line_dedup,
    "op10_chat": op10_chat,
}

ORACLES: dict[str, str] = {
    "op2_mixing": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        s AS (SELECT skey, source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY skey, source),
        w AS (SELECT *, [5e0, 2e0, 1e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2e0 * source_size AS cap FROM s),
        v AS (SELECT *, (15e-1 * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0e0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0e0)) AS level
              FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT skey, source_size, n_docs, least(cap, max(level) OVER () * weight) AS target FROM v),
        n AS (SELECT floor(sum(target) / 32 + 5e-1)::BIGINT AS seats FROM t),
        k AS (SELECT skey, target, unnest(range((SELECT seats FROM n))) AS k FROM t WHERE target > 0),
        q AS (SELECT skey, count(*) AS source_quota FROM (SELECT skey, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, skey, k) AS p FROM k) WHERE p <= (SELECT seats FROM n) GROUP BY skey),
        x AS (SELECT d.*, target, source_size, coalesce(source_quota, 0) AS source_quota, ('0x' || substr(md5(concat_ws(':', 17, doc_id, size)), 1, 15))::BIGINT AS h, ceil(n_docs / 2048)::BIGINT AS n_shards FROM d JOIN t USING (skey) LEFT JOIN q USING (skey)),
        y AS (SELECT *, (h >> 7) % n_shards AS shard FROM x),
        c AS (SELECT skey, shard, sum(size)::BIGINT AS words, max(source_quota) AS source_quota FROM y GROUP BY skey, shard),
        ck AS (SELECT skey, shard, words, source_quota, unnest(range(source_quota)) AS k FROM c WHERE words > 0),
        cq AS (SELECT skey, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY words / (2 * k + 1) DESC, shard, k) AS p FROM ck) WHERE p <= source_quota GROUP BY skey, shard),
        cb AS (SELECT skey, shard, words, greatest(1, floor(words / 32 + 5e-1))::BIGINT AS blocks, coalesce(quota, 0) AS quota FROM c LEFT JOIN cq USING (skey, shard)),
        ct AS (SELECT skey, shard, words, blocks, least(quota, 2 * blocks) AS quota, ('0x' || substr(md5(concat_ws(':', 17, skey, shard)), 1, 15))::BIGINT % blocks AS turn FROM cb),
        z AS (SELECT y.*, words, blocks, quota, turn, coalesce(sum(size) OVER (PARTITION BY skey, shard ORDER BY h, doc_id, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM y JOIN ct USING (skey, shard)),
        o AS (SELECT r, a, a + size AS e, words, blocks, quota, turn, unnest(range(((a + 1) * blocks - 1) // words, ((a + size) * blocks - 1) // words + 1)) AS i FROM z WHERE size > 0),
        g AS (SELECT r, sum((least(((i + 1) * words) // blocks, e) - greatest((i * words) // blocks, a)) * (quota // blocks + CASE WHEN (i * 2147483629 + turn) % blocks < quota % blocks THEN 1 ELSE 0 END))::BIGINT AS taken FROM o GROUP BY r)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM z LEFT JOIN g USING (r)
    """,
    "op5_jaccard": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT doc_id, w, least(len(w), 5) AS n, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0),
        g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM i),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS c FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS MATERIALIZED (SELECT p, q, c = x.n AND c = y.n AS same FROM p JOIN n x ON p = x.doc_id JOIN n y ON q = y.doc_id WHERE 5 * c >= 4 * (x.n + y.n - c)),
        reach AS (SELECT doc_id, doc_id AS q FROM d UNION SELECT r.doc_id, e.q FROM reach r JOIN e ON r.q = e.p),
        c AS (SELECT doc_id, min(q) AS class_id FROM reach GROUP BY doc_id),
        l AS (SELECT p AS doc_id, count(*) AS n_links, min(q) FILTER (WHERE same) AS copy FROM e GROUP BY p)
        SELECT c.doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, least(c.doc_id, coalesce(copy, c.doc_id)) AS copy_id, coalesce(n.n, 0)::BIGINT AS n_grams
        FROM c LEFT JOIN l USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
    "op9_line_dedup": r"""
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS line FROM d),
        f AS (SELECT doc_id, line, trim(regexp_replace(raw, '[\x09-\x0D]', ' ', 'g')) AS t FROM l),
        w AS (SELECT doc_id, line, t, len(regexp_split_to_array(t, ' +')) AS n FROM f WHERE t <> ''),
        b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w),
        e AS (SELECT *, before + n AS upto FROM b),
        s AS (SELECT 0 AS kind, doc_id, line, max(line) OVER r AS last, sum(n) OVER r AS total, string_agg(t, chr(10)) OVER r AS run FROM e WINDOW r AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 50 FOLLOWING)
              UNION ALL SELECT 1, doc_id, min(line) OVER r, line, sum(n) OVER r, string_agg(t, chr(10)) OVER r FROM e WINDOW r AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 50 PRECEDING AND CURRENT ROW)),
        k AS (SELECT *, row_number() OVER (PARTITION BY kind, run ORDER BY doc_id, line) AS c FROM s WHERE total >= 51),
        g AS (SELECT DISTINCT doc_id, unnest(range(line, last + 1)) AS line FROM k WHERE c > 1),
        n AS (SELECT l.doc_id, count(g.line) AS n_deleted, coalesce(string_agg(raw, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS kept FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
        SELECT d.doc_id, len(ls)::BIGINT AS n_lines, n_deleted::BIGINT AS n_deleted, CASE WHEN n_deleted > 0 THEN kept ELSE text END AS text FROM d JOIN n USING (doc_id)
    """,
    # The tables hold finite vectors of one length.
    "op4_embeddings": r"""
        WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
        e AS MATERIALIZED (SELECT a.vec_id AS p, b.vec_id AS q FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.95e0),
        reach AS (SELECT vec_id, vec_id AS q FROM u UNION SELECT r.vec_id, e.q FROM reach r JOIN e ON r.q = e.p),
        c AS (SELECT vec_id, min(q) AS component_id FROM reach GROUP BY vec_id),
        l AS (SELECT p AS vec_id, count(*) AS n FROM e GROUP BY p)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN l USING (vec_id)
    """,
    "op1_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
        bs AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM bs),
        lens AS (SELECT DISTINCT n FROM bw),
        ds AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
        dw AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM ds),
        h AS (SELECT r, i, dw.n, item FROM dw JOIN bw USING (n, g)),
        hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
        hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
    """,
    # The tables hold no tool messages, so links, orphans and invalid calls are all 0 here.
    "op10_chat": r"""
        WITH m AS (SELECT conv_id, turn // 512 AS part, turn, role, text, '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}' AS j FROM conversations)
        SELECT conv_id, part::BIGINT AS part, count(*)::BIGINT AS n_messages, 0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_orphans, 0::BIGINT AS n_invalid,
               '{"conv_id":' || conv_id || ',"messages":[' || string_agg(j, ',' ORDER BY turn, role, text) || '],"part":' || part || '}' AS json
        FROM m GROUP BY conv_id, part
    """,
}
