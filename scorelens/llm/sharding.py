"""Sharding by sampled splitters, in DataFrame operations only.

Records are put in one total order by (hash of the text, hash of the id), so that equal texts are neighbours and
the order says nothing about size or source. Splitters cut this order into ranges: keys are drawn with a
probability in proportion to their size (bytes plus a row's mean bytes, so that neither bytes nor rows pile up in a
range), the quantiles of the drawn weights are the boundaries, and records are range-partitioned by them. Ranges that
turn out overfull when they are measured (a text with thousands of copies, or a draw that was off) are subdivided
by splitters drawn from inside them, down to single rows if need be. Then every range has its exact bytes and rows, a prefix
sum over the ranges gives each its place in the order, and one window a range gives each record its own.

Shard ``s`` takes the records whose middle lies in the s-th part of all bytes (law ``bytes``) or whose rank lies in
the s-th part of all rows (law ``rows``). The splitters decide who does the work, not the result, so
results do not depend on the draw. Under ``bytes`` a group of equal texts that a shard's end would cut goes whole to
the side of its middle, if it is small (``WHOLE`` of a shard's bytes); a larger group is cut between rows.

Bounds: at most ``RANGES`` boundaries and ``DRAWS`` expected keys a draw in the first round; in the second a table of
pieces of ``RANGE_ROWS`` rows or an even share, drawn within each range. Per shard and per cut group one row reaches the driver.

Defined results: null text counts as none (size 1, the same group as an empty one); a null id is an id like any
other; repeated rows are rows of their own; an empty table gives no rows; other columns are ignored (or handed on in
one struct, so that no name can clash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelens.functions.hashing import md5_long
from scorelens.llm.common import stored
from scorelens.operators.joins import checked_broadcast

RANGES, RANGE_ROWS, DRAWS = 1024, 1_000_000, 16  # first boundaries at most; rows of a piece; expected keys drawn for each range
LEAST_ROWS = 100  # small tables get fewer ranges
WHOLE = 100  # a cut group goes whole to one side if it has at most one WHOLE-th of a shard's bytes
STEP = 32  # boundaries are found in two looks: among every STEP-th one, then among STEP neighbours

_KEY = ["h1", "h2", "row"]


def shard(df: DataFrame, shards: int = 8, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text",
          record: bool = False) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of ``df``, and its columns as struct ``record`` if asked for."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law}")
    handed = ["record"] if record else []
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = stored(df.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                            F.crc32(text.cast("binary")).alias("text_crc32"), md5_long(text).alias("h1"),
                            md5_long(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).alias("h2"),
                            F.monotonically_increasing_id().alias("row"), *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record")] if record else [])),
                  "shard_rows")
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    if not total["rows"]:
        return rows.select("id", "size", "text_crc32", F.lit(0).alias("shard"), F.col("row").alias("slot"), *handed)

    ranges = max(1, min(RANGES, total["rows"] // LEAST_ROWS))
    placed = _placed(rows, total, ranges)
    sizes = placed.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sizes.select("range", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("range").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (placed.withColumn("end", F.sum("size").over(inside)).withColumn("nth", F.count("*").over(inside))
              .join(checked_broadcast(stored(offsets, "shard_offsets")), "range")
              .select("id", "size", "text_crc32", "h1", (F.col("b0") + F.col("end") - F.col("size")).alias("start"),
                      (F.col("n0") + F.col("nth") - 1).alias("rank"), *handed))
    if law == "rows":
        ranked = ranked.withColumn("shard", _part(2 * F.col("rank") + 1, shards, total["rows"]))
    else:
        ranked = ranked.withColumn("shard", _part(2 * F.col("start") + F.col("size"), shards, total["bytes"]))
    ranked = stored(ranked, "shard_ranks")
    if law == "bytes":
        ranked = _whole_groups(ranked, shards, total["bytes"])
    first = {r["shard"]: r["first"] for r in ranked.groupBy("shard").agg(F.min("rank").alias("first")).collect()}  # a row a shard
    base = F.coalesce(*[F.when(F.col("shard") == s, F.lit(n)) for s, n in sorted(first.items())])
    return ranked.select("id", "size", "text_crc32", "shard", (F.col("rank") - base).cast("long").alias("slot"), *handed)


def write_shards(df: DataFrame, path: str, shards: int = 8, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text") -> None:
    """The shards as Parquet: ``path/shard=<s>/`` with (slot, record), each file a run of slots in their order."""
    found = shard(df, shards, law, id_col, text_col, record=True).select("shard", "slot", "record")
    (found.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))


def _part(middle2: Column, parts: int, total: int) -> Column:
    """Which of ``parts`` equal parts of ``total`` the middle lies in, given twice the middle."""
    return F.least(F.lit(parts - 1), F.call_function("div", middle2 * F.lit(parts), F.lit(2 * total))).cast("int")


def _placed(rows: DataFrame, total, ranges: int) -> DataFrame:
    """``rows`` with the id of their range; ids follow the order of the keys."""
    mean = total["bytes"] / total["rows"]
    weight, whole = F.col("size") + F.lit(mean), 2.0 * total["bytes"]
    drawn = _drawn(rows.withColumn("weight", weight), F.lit(whole / (ranges * DRAWS)))
    crossed = Window.orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over the draw alone, bounded
    edges = _edges(drawn.withColumn("end", F.sum("weight").over(crossed)), F.lit(whole / ranges))
    first = sorted({r["h1"] for r in edges.select("h1").distinct().collect()})  # at most ``ranges``
    placed = rows.withColumn("one", _count(_longs(first), _longs(first[STEP - 1::STEP]), F.col("h1")))

    piece = min(whole / ranges, 2.0 * RANGE_ROWS * mean)
    share = (F.col("b") + F.col("n") * mean) / piece
    full = (placed.groupBy("one").agg(F.sum("size").alias("b"), F.count("*").alias("n")).withColumn("share", share)
            .where((F.col("share") > 2) & (F.col("n") > 1)).select("one"))
    full = stored(full, "shard_full")
    within = _drawn(placed.join(checked_broadcast(full), "one", "left_semi").withColumn("weight", weight), F.lit(piece / DRAWS))
    crossed = Window.partitionBy("one").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = _edges(within.withColumn("end", F.sum("weight").over(crossed)), F.lit(piece))
    # A cut inside a group of equal texts moves to the group's start, unless the cut before it is inside the same group.
    earlier = F.lag("h1").over(Window.partitionBy("one").orderBy(*_KEY))
    key = F.when(F.col("h1") == earlier, F.struct(*_KEY)).otherwise(F.struct("h1", F.lit(-1).cast("long").alias("h2"), F.lit(-1).cast("long").alias("row")))
    fine = cuts.select("one", key.alias("key")).groupBy("one").agg(F.array_sort(F.collect_list("key")).alias("fine"))  # a key a piece
    fine = stored(fine, "shard_cuts").withColumn("coarse", F.transform(F.sequence(F.lit(0), F.floor(F.size("fine") / STEP).cast("int")), lambda k: F.get("fine", k * STEP + STEP - 1)))
    fine = fine.withColumn("coarse", F.filter("coarse", lambda k: k.isNotNull()))
    both = placed.join(checked_broadcast(fine), "one", "left")
    two = F.when(F.col("fine").isNull(), 0).otherwise(_count(F.col("fine"), F.col("coarse"), F.struct(*_KEY)))
    return both.withColumn("range", F.col("one").cast("long") * F.lit(1 << 32) + two).drop("one", "fine", "coarse")


def _drawn(rows: DataFrame, step: Column) -> DataFrame:
    """Rows drawn with probability weight / step (at most 1), each standing for the weight ``step`` at least."""
    even = F.shiftrightunsigned(F.xxhash64(*_KEY), 11).cast("double") / F.lit(float(1 << 53))
    return rows.where(even * step < F.col("weight")).select(*[c for c in ("one", *_KEY) if c in rows.columns], F.greatest("weight", step).alias("weight"))


def _edges(summed: DataFrame, each: Column) -> DataFrame:
    """The drawn keys at which the weights summed so far pass another multiple of ``each``."""
    return summed.where(F.floor(F.col("end") / each) > F.floor((F.col("end") - F.col("weight")) / each))


def _longs(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<long>")


def _count(fine: Column, coarse: Column, key: Column) -> Column:
    """How many of the sorted boundaries ``fine`` are at most ``key``; ``coarse`` holds every STEP-th of them."""
    skipped = F.size(F.filter(coarse, lambda b: b <= key)) * STEP
    return (skipped + F.size(F.filter(F.slice(fine, skipped + 1, STEP), lambda b: b <= key))).cast("int")


def _whole_groups(ranked: DataFrame, shards: int, total: int) -> DataFrame:
    """Small groups that a shard's end cuts go to the side of their middle: at most one group an end."""
    ends = ranked.groupBy("shard").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).orderBy("shard").collect()  # a row a shard
    cut = sorted({a["high"] for a, b in zip(ends, ends[1:], strict=False) if a["high"] == b["low"]})
    if not cut:
        return ranked
    groups = (ranked.where(F.col("h1").isin(cut)).groupBy("h1").agg(F.sum("size").alias("size"), F.min("start").alias("start"))
              .withColumn("shard", _part(2 * F.col("start") + F.col("size"), shards, total)).collect())
    moved = [F.when(F.col("h1") == g["h1"], F.lit(g["shard"])) for g in groups if g["size"] * shards * WHOLE <= total]
    return ranked.withColumn("shard", F.coalesce(*moved, F.col("shard")))

