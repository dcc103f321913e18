"""Exact dedup by progressive refinement, in DataFrame operations only.

Texts are equal when identical without white space. Rows are grouped by normalised length and,
within a length, by the hash of a short prefix; only what still shares both is read in full and hashed
with SHA-256. The first two rounds come from one scan, whose narrow rows are written once, and are one aggregate over a few numbers a
row, combined before the shuffle: a group of copies holding a third of all rows costs one partial row a task.
The second scan joins texts with the (length, prefix) pairs that several rows share: broadcast where they are counted to be
few, so that no text is shuffled at all, else by shuffle, with Spark's runtime Bloom filter in front of it on large inputs. Only what passes is
hashed, once, and written narrow; the last round works on those rows.

Defined results: null counts as empty; empty and all-space texts are equal to each other; of equal
texts the row with most code points, then the smallest id stays (a null id comes last); repeated
rows of the id that stays all say ``kept``. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.llm.common import SPACES, stored
from scorelens.operators.joins import checked_broadcast

PREFIX = 64


def normalised(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None,
          prefix: int = PREFIX) -> DataFrame:
    """(id, keep_id, group_size, kept, *carry) for each row of ``df``, dropped ones too.

    ``carry``: narrow columns to hand through, computed where a text is scanned, over the column ``text``.
    Repeated rows with one id and equal texts: each says ``kept`` if its id is the one that stays.
    """
    carry = carry or {}
    plain = normalised(F.col("text"))
    texts = (df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
             .select("id", "text", F.length("text").alias("raw_length"), F.length(plain).alias("length"), F.xxhash64(F.substring(plain, 1, prefix)).alias("prefix")))
    pair, narrow = ["length", "prefix"], ["id", "raw_length", "length", "prefix"]
    handed = [c.alias(name) for name, c in carry.items()]
    rows = stored(texts.select(*narrow, *handed), "exact_rows")
    shared = checked_broadcast(stored(rows.groupBy(*pair).agg(F.count("*").alias("n")).where("n > 1").select(*pair), "exact_shared"))

    alone = rows.join(shared, pair, "left_anti")
    full = stored(texts.join(shared, pair, "left_semi").select(*narrow, F.sha2(plain, 256).alias("full"), *handed), "exact_full")
    first = F.min(F.struct((-F.col("raw_length")).alias("shorter"), F.col("id").isNull().alias("unnamed"), F.col("id").alias("id")))
    groups = full.groupBy(*pair, "full").agg(F.count("*").alias("group_size"), first.alias("first"))
    together = (full.join(checked_broadcast(groups), [*pair, "full"])
                .select("id", F.col("first.id").alias("keep_id"), "group_size",
                        F.col("id").eqNullSafe(F.col("first.id")).alias("kept"), *carry))
    single = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *carry)
    return single.unionByName(together)
