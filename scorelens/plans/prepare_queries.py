"""Reproducible preparation: hash splits and samples, shuffles, batch schedules, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.functions.hashing import md5_bucket
from scorelens.functions.text import tokens_mask, tokens_pad_to, tokens_pad_truncate, words
from scorelens.operators import rows, splits
from scorelens.plans import testdata
from scorelens.plans.evaluate import collate, prepare_text
from scorelens.plans.registry import query, table

MD5_BUCKET_SQL = "('0x' || substr(md5({salt}CAST({key} AS VARCHAR)), 1, 8))::BIGINT % {n}"


def bucket_sql(key: str, n: int = 100, salt: str = "") -> str:
    return MD5_BUCKET_SQL.format(key=key, n=n, salt=f"'{salt}' || " if salt else "")


# The reference's split fractions and sample rate, text length limit,
# growth step and random-size bounds of its micro-batch producer.
TRAIN_PCT = 98
TRAIN_PCT_TEXT = 70
SAMPLE_PCT = 5
MAX_TOKENS = 512
GROWTH_STEP = 5
RANDOM_LO, RANDOM_HI = 50, 200
CONSTANT_BATCH = 7


@query("split_hash_98_2", f"""
SELECT doc_id, CASE WHEN {bucket_sql('doc_id')} < {TRAIN_PCT} THEN 'train' ELSE 'test' END AS split FROM documents""")
def split_hash_98_2(spark, d):
    return splits.hash_split(table(spark, d, "documents", "doc_id"), "doc_id", TRAIN_PCT)


@query("split_hash_70_30", f"""
SELECT doc_id, label, CASE WHEN {bucket_sql('doc_id', salt='s42')} < {TRAIN_PCT_TEXT} THEN 'train' ELSE 'test' END AS split
FROM (SELECT d.doc_id, l.toxic AS label FROM documents d JOIN labels l USING (doc_id))""")
def split_hash_70_30(spark, d):
    lt = testdata.labelled_text(spark, d).select("doc_id", "label")
    return splits.hash_split(lt, "doc_id", TRAIN_PCT_TEXT, salt="s42")


@query("sample_hash_bernoulli", f"""
SELECT doc_id, n_chars FROM documents WHERE {bucket_sql('doc_id', salt='keep')} < {SAMPLE_PCT}""")
def sample_hash_bernoulli(spark, d):
    return splits.bernoulli_sample(table(spark, d, "documents", "doc_id", "n_chars"), "doc_id", SAMPLE_PCT, "keep")


@query("shuffle_hash_order", f"""
SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(md5('mix' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT, doc_id) - 1
       AS position FROM documents""")
def shuffle_hash_order(spark, d):
    return rows.shuffle_positions(table(spark, d, "documents", "doc_id"), "doc_id", salt="mix")


@query("assign_batches_constant", f"""
SELECT vec_id, CAST((row_number() OVER (ORDER BY vec_id) - 1) // {CONSTANT_BATCH} AS BIGINT) AS batch_no
FROM embeddings""")
def assign_batches_constant(spark, d):
    e = table(spark, d, "embeddings", "vec_id")
    return rows.assign_constant(e, [F.col("vec_id")], CONSTANT_BATCH).select("vec_id", "batch_no")


@query("assign_batches_increasing", f"""
SELECT event_id, CAST(ceil((sqrt(8.0::DOUBLE * rn / {GROWTH_STEP}.0::DOUBLE + 1.0) - 1.0) / 2.0) AS BIGINT) AS batch_id
FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events)""")
def assign_batches_increasing(spark, d):
    e = table(spark, d, "events", "event_id")
    return rows.assign_increasing(e, [F.col("event_id")], GROWTH_STEP).select("event_id", "batch_id")


@query("assign_batches_random", f"""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events),
b AS (SELECT range AS batch_id, {RANDOM_LO} + {bucket_sql('range', RANDOM_HI - RANDOM_LO + 1, 'batch')} AS n
      FROM range(1, CAST(ceil((SELECT count(*) FROM events) / {RANDOM_LO}.0) AS BIGINT) + 1)),
c AS (SELECT batch_id, sum(n) OVER (ORDER BY batch_id) - n AS lo, n FROM b)
SELECT event_id, CAST(batch_id AS BIGINT) AS batch_id FROM r JOIN c ON rn >= lo AND rn < lo + n""")
def assign_batches_random(spark, d):
    e = table(spark, d, "events", "event_id")
    return rows.assign_random(e, [F.col("event_id")], RANDOM_LO, RANDOM_HI).select("event_id", "batch_id")


@query("sample_with_replacement", """
WITH r AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS rn FROM embeddings),
d AS (SELECT range AS draw, ('0x' || substr(md5('draw' || CAST(range AS VARCHAR)), 1, 15))::BIGINT
             % (SELECT count(*) FROM embeddings) AS rn
      FROM range(0, (SELECT count(*) FROM embeddings)))
SELECT draw, vec_id, label FROM d JOIN r USING (rn)""")
def sample_with_replacement(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "label")
    return rows.sample_with_replacement(e, [F.col("vec_id")]).select("draw", "vec_id", "label")


TOKENS_SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS w
           FROM documents)
"""


@query("text_tokens_pad_truncate", TOKENS_SQL + f"""
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words,
       w[1:{MAX_TOKENS}] || list_transform(range(greatest(0, {MAX_TOKENS} - len(w))), lambda i: '[PAD]') AS tokens,
       list_transform(range({MAX_TOKENS}), lambda i: CASE WHEN i < least(len(w), {MAX_TOKENS}) THEN 1 ELSE 0 END) AS mask
FROM w""")
def text_tokens_pad_truncate(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    # Every word of the whole text is counted; the token list keeps the first
    # MAX_TOKENS (the tokenizer's truncation) and pads the rest.
    return docs.select("doc_id", F.size(words("text")).alias("n_words"),
                       tokens_pad_truncate("text", MAX_TOKENS).alias("tokens"),
                       tokens_mask("text", MAX_TOKENS).alias("mask"))


@query("prepare_text_split", f"""
SELECT doc_id, content, label, CASE WHEN {bucket_sql('doc_id')} < {TRAIN_PCT} THEN 'train' ELSE 'test' END AS split,
       row_number() OVER (ORDER BY ('0x' || substr(md5('mix' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT, doc_id) - 1 AS position
FROM (SELECT d.doc_id, d.text AS content, l.toxic AS label FROM documents d JOIN labels l USING (doc_id))""")
def prepare_text_split(spark, d):
    return prepare_text(testdata.labelled_text(spark, d), TRAIN_PCT)


@query("union_splits", f"""
SELECT vec_id, label, 'train' AS split FROM embeddings WHERE {bucket_sql('vec_id')} < {TRAIN_PCT}
UNION ALL
SELECT vec_id, label, 'test' AS split FROM embeddings WHERE {bucket_sql('vec_id')} >= {TRAIN_PCT}""")
def union_splits(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "label")
    train = e.filter(md5_bucket("vec_id") < TRAIN_PCT).withColumn("split", F.lit("train"))
    test = splits.rest_after(e, train, "vec_id").withColumn("split", F.lit("test"))
    return train.unionByName(test)


@query("collate_batches", f"""
WITH r AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS rn FROM embeddings)
SELECT CAST(rn // {CONSTANT_BATCH} AS BIGINT) AS batch_no, list(vec_id ORDER BY rn) AS ids,
       list(label ORDER BY rn) AS labels FROM r GROUP BY rn // {CONSTANT_BATCH}""")
def collate_batches(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "label")
    b = rows.assign_constant(e, [F.col("vec_id")], CONSTANT_BATCH)
    return collate(b, "batch_no", "rn", {"ids": "vec_id", "labels": "label"})


TEXT_BATCH = 16


@query("text_tokens_pad_longest", TOKENS_SQL + f"""
, b AS (SELECT doc_id, w, CAST((row_number() OVER (ORDER BY doc_id) - 1) // {TEXT_BATCH} AS BIGINT) AS batch_no FROM w),
m AS (SELECT *, max(least(len(w), {MAX_TOKENS})) OVER (PARTITION BY batch_no) AS longest FROM b)
SELECT doc_id, batch_no, CAST(longest AS INTEGER) AS longest,
       w[1:{MAX_TOKENS}] || list_transform(range(greatest(0, longest - least(len(w), {MAX_TOKENS}))), lambda i: '[PAD]')
       AS tokens
FROM m""")
def text_tokens_pad_longest(spark, d):
    """Pad every text to the longest (truncated) text of its mini-batch."""
    docs = rows.assign_constant(table(spark, d, "documents", "doc_id", "text"), [F.col("doc_id")], TEXT_BATCH)
    n_tok = F.least(F.size(words("text")), F.lit(MAX_TOKENS))
    # A mini-batch holds at most TEXT_BATCH rows, so the per-batch maximum is a
    # bounded aggregate joined back on the batch number.
    longest = docs.groupBy("batch_no").agg(F.max(n_tok).cast("int").alias("longest"))
    return docs.join(longest, "batch_no").select(
        "doc_id", "batch_no", "longest", tokens_pad_to("text", F.col("longest"), MAX_TOKENS).alias("tokens"))
