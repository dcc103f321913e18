"""One registered query per operator: the operator over its whole table, cut to its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.llm import compression, exact, hard_negatives, langid, license_scan, line_dedup, lm, packing, quality, secret_scan, sentence_pieces, sharding, simhash
from scorelens.llm.common import crc32_mod, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_secret_scans")
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *map(count, secret_scan.KINDS[:3]),
                        F.sha2(secret_scan.digest(F.col("findings"), secret_scan.KINDS[:3]), 256).alias("base_sha256"),
                        secret_scan.digest(F.col("findings")).alias("spans"), *map(count, secret_scan.KINDS[3:]))


@query("op2_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc32_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(documents, ~held_out)
    return (langid.identify(documents, model).withColumnRenamed("id", "doc_id")
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))


@query("op3_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op4_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), *quality.COUNTS, "base_failed", "kept", "path_length")


@query("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op9_line_dedup")
def fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines"))
    left = line_dedup.dedup_lines(documents, keys=line_dedup.KEYS)
    return left.select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"),
                       F.array_join(F.transform("removed_lines", lambda n: n.cast("string")), ",").alias("removed_lines"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op6_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc32_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    trained = lm.train(documents, ~held_out & F.col("doc_id").isNotNull())
    return (lm.score(documents, trained).withColumnRenamed("id", "doc_id")
            .select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(trained.total).cast("long").alias("train_tokens"),
                    "base_score", "score", "bits_per_byte"))


@query("op7_license_scans")
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.array_join("families", ",").alias("families"),
                        "n_confirmed", "n_unknown", "best_probability")


@query("op8_sentencepiece")
def sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_digest(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


EXACT_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS raw,
                  sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
           FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY raw DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY raw DESC, doc_id) AS kept, text_sha256
FROM d
"""


@query("op10_exact_dedup", EXACT_SQL)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(exact.normalised(F.col("text")), 256)
    found = exact.dedup(read(spark, sf_dir, "documents"), carry={"text_sha256": digest})
    return found.withColumnRenamed("id", "doc_id")


_NEAREST_SQL = """
a{n} AS (SELECT vec_id, label, p, part, min(d * {k} + e) % {k} AS e, min(d * {k} + e) // {k} AS d FROM (
  SELECT vec_id, label, x.p, part, e, CAST(list_sum(list_transform(list_zip(part, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM x JOIN c{n} ON x.p = c{n}.p) GROUP BY vec_id, label, p, part)"""
_MOVED_SQL = """
c{m} AS (SELECT p, e, coalesce(u.c, old.c) AS c FROM c{n} old LEFT JOIN (
  SELECT p, e, list(m ORDER BY j) AS c FROM (SELECT p, e, j, CAST(floor(sum(part[j])::DOUBLE / count(*)) AS BIGINT) AS m
                                             FROM a{n}, range(1, 9) t(j) GROUP BY p, e, j) GROUP BY p, e) u USING (p, e))"""
COMPRESSION_SQL = """
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(v::DOUBLE * 4096) AS BIGINT)) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS (SELECT vec_id, label, p, v[p * 8 + 1 : p * 8 + 8] AS part FROM kept, range(8) t(p)),
c0 AS (SELECT x.p, e, part AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 16) USING (vec_id)),""" + ",".join(
    _NEAREST_SQL.format(n=n, k=compression.ENTRIES) + "," + _MOVED_SQL.format(n=n, m=n + 1) for n in range(compression.ROUNDS)) + "," + _NEAREST_SQL.format(
    n=compression.ROUNDS, k=compression.ENTRIES) + f""",
r AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
      FROM a{compression.ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{compression.ROUNDS}) AS codebooks_sha256
FROM r
"""


@query("op11_vector_compression", COMPRESSION_SQL)
def vector_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compression.compress(read(spark, sf_dir, "embeddings"))
    books = F.sha2(F.lit(compression.codebook_text(found.codebooks)), 256)
    return compression.with_label_error(found.rows).select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error",
                                                           "label_error", books.alias("codebooks_sha256"))


HARD_NEGATIVES_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda v: CAST(floor(v::DOUBLE * 256) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op12_hard_negatives", HARD_NEGATIVES_SQL)
def hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label)


def _crc32_sql(text: str) -> str:
    """CRC-32 of UTF-8 text, byte by byte; the table's value for a byte is the sum of those of its bits."""
    def powers(value: int) -> int:
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        return value
    step = "a >> 8"
    for bit in range(8):
        step = f"xor({step}, ((xor(a, b) >> {bit}) & 1) * {powers(1 << bit)})"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce({data}, lambda a, b: {step}, 4294967295), 4294967295)"


SHARDING_SQL = f"""
WITH r AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {_crc32_sql("coalesce(text, '')")} AS text_crc32,
                  CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS h1,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h2 FROM documents),
o AS (SELECT *, CAST(sum(size) OVER (ORDER BY h1, h2 ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start,
             row_number() OVER (ORDER BY h1, h2) - 1 AS nth, CAST(sum(size) OVER () AS BIGINT) AS total FROM r),
s AS (SELECT *, least(7, (2 * start + size) * 8 // (2 * total)) AS own FROM o),
g AS (SELECT *, min(own) OVER (PARTITION BY h1) < max(own) OVER (PARTITION BY h1) AS cut,
             CAST(sum(size) OVER (PARTITION BY h1) AS BIGINT) AS together, min(start) OVER (PARTITION BY h1) AS low FROM s),
f AS (SELECT *, CAST(CASE WHEN cut AND together * 8 * {sharding.WHOLE} <= total THEN least(7, (2 * low + together) * 8 // (2 * total))
                          ELSE own END AS INTEGER) AS shard FROM g)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, nth - min(nth) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM f
"""


@query("op13_sharding", SHARDING_SQL)
def sampled_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(read(spark, sf_dir, "documents"), shards=8, law="bytes")
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
