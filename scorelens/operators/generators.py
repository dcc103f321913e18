"""One row -> many: log histories, batch outputs, unpivots (see relabel.unpivot)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_with_position(df: DataFrame, array_col: str, keep: list[str],
                          pos: str = "pos", item: str = "log") -> DataFrame:
    """``posexplode``: one row per array element with its position (ties keep order)."""
    return df.select(*keep, F.posexplode(array_col).alias(pos, item))


def explode_batches(per_batch: DataFrame, arrays: dict[str, str], repeat: list[str]) -> DataFrame:
    """Parallel per-batch arrays -> one row per item; ``repeat`` columns copied."""
    names = list(arrays)
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])
    out = per_batch.select(*repeat, F.explode(zipped).alias("_it"))
    return out.select(*[F.col(f"_it.{n}").alias(n) for n in names], *repeat)


def pack_segments(numbered: DataFrame, key: str, position: str, item, segment: int,
                  item_name: str = "items") -> DataFrame:
    """Pack ordered items into documents of at most ``segment`` items per key.

    ``numbered`` carries a global position (``rows.with_row_number`` over
    (key, order...)), so the items of a key are consecutive. Documents are
    (key, segment, offset, items) where ``offset`` is the position of the
    document's first item within its key: a hot key becomes many bounded
    documents instead of one unbounded array.
    """
    segs = numbered.groupBy(F.col(key), F.floor(F.col(position) / segment).cast("bigint").alias("segment")).agg(
        F.min(position).alias("_first"),
        F.array_sort(F.collect_list(F.struct(F.col(position).alias("_p"), item.alias("_i")))).alias("_items"))
    key_first = segs.groupBy(key).agg(F.min("_first").alias("_key_first"))
    return segs.join(key_first, key).select(
        key, "segment", (F.col("_first") - F.col("_key_first")).alias("offset"),
        F.transform("_items", lambda x: x["_i"]).alias(item_name))
