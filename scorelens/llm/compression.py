"""Vector code compression: product codes whose codebooks are fitted by ball k-means, in integers.

Vectors become integers and are cut into equal consecutive parts; each part position has a codebook of a few entries. A
round assigns every part to its nearest entry (ties to the lower index) and moves each entry to the floor of
its parts' mean. After the first round parts are not compared with all entries. The parts of an entry form a ball;
its radius is the largest distance of its parts from the moved entry. Only entries nearer than twice the radius are its
neighbours; a ball that has none, or that did not move and none of whose neighbours did, keeps all its parts. Within a ball, parts
nearer than half the way to the nearest neighbour are its stable core and stay; the rest lies in rings, and a part in the k-th ring is
compared with the first k neighbours alone. Bounds are taken with "at least", so ties reach the lower index and the result
is that of comparing with every entry. Balls are held slice by slice of a task's rows; a slice's radius is at most the
ball's, so its neighbours are the ones its rows need.

Each round is one pass over the vectors: tasks read them with their codes, write them with the new ones, and add one
row of sums for each entry, which Spark sums up; the driver sees parts x entries sums. The table of the round before goes when the next one is
written, so a lost executor repeats one round at most and disk holds two tables. No statistic is sampled.

Defined results: rows whose vector is null, holds null or non-finite components, or has another length than that of the first
kept row (by id) take no part; a null id comes last; of rows that repeat an id among the first ones, the smallest vector counts for the
first codebook; fewer ids than entries give fewer entries; repeated rows are rows of their own; null labels form one group; an
empty table gives no rows; other columns are ignored. Components over 2^15 in magnitude (at scale 4096) are an error, since squares would
not fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.operators.joins import checked_broadcast
from scorelens.session import scratch_path

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMIT = 1 << 27  # components beyond it could overflow squared distances
SLICE_VALUES = 2_000_000  # components of a slice


@dataclass
class Compressed:
    """Codes and errors of all kept rows (id, label, codes binary, error long), and the codebooks (parts, entries, width)."""

    rows: DataFrame
    codebooks: np.ndarray


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Compressed:
    """Fit the codebooks on all kept rows and code them."""
    spark = df.sparkSession
    kept = (df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
            .where(usable(F.col("vector"))).select("id", "label", integers(F.col("vector"), scale).alias("v")))
    start = _first_vectors(kept, entries)
    schema = f"id {kept.schema['id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}"
    if not start:
        none = spark.createDataFrame([], f"{schema}, codes binary, error long")
        return Compressed(none, np.zeros((parts, 0, 0), np.int64))
    dims = len(start[0])
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    books = np.array(start, np.int64).reshape(len(start), parts, dims // parts).transpose(1, 0, 2)
    now, path, before = kept.where(F.size("v") == dims).withColumn("codes", F.lit(None).cast("binary")), None, None
    for _ in range(rounds):
        found, new_path = _written(_assign(now, books, before, schema, sums=True), "codes")
        if path:
            _drop(spark, path)
        now, path, before = found.where("sums is null").select("id", "label", "v", "codes"), new_path, books
        books = _moved(found, books)
    found, _ = _written(_assign(now, books, before, schema, sums=False).select("id", "label", "codes", "error"), "coded")
    _drop(spark, path)
    return Compressed(found, books)


def with_label_error(rows: DataFrame) -> DataFrame:
    """Add ``label_error``: the error summed over equal labels, nulls together."""
    labels = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    labels, _ = _written(labels, "label_errors")
    labels = checked_broadcast(labels.withColumnRenamed("label", "same"))
    return rows.join(labels, F.col("label").eqNullSafe(F.col("same"))).drop("same")


def codebook_text(books: np.ndarray) -> str:
    """All entries' components by part, entry and position, comma-joined."""
    return ",".join(str(int(x)) for x in books.reshape(-1))


def decode(codes: bytes, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([books[p, c] for p, c in enumerate(codes)]) if codes else np.zeros(0, np.int64)


def _first_vectors(kept: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the smallest ids, ascending; one vector for each id."""
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    top = kept.select("id", "v").orderBy(*order).limit(entries).collect()  # ``entries`` rows
    if len({r["id"] for r in top}) < len(top):  # an id repeats: take the smallest distinct ones
        ids = kept.select("id").distinct().orderBy(order[0]).limit(entries)
        own = kept.join(F.broadcast(ids.withColumnRenamed("id", "first")), F.col("id").eqNullSafe(F.col("first")))
        top = own.groupBy("id").agg(F.min("v").alias("v")).orderBy(order[0]).collect()
    return [r["v"] for r in top if len(r["v"]) == len(top[0]["v"])]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _drop(spark: SparkSession, path: str) -> None:
    """Remove a table of an earlier round, which nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _moved(found: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries at the floor of their parts' mean; unused ones stay."""
    sums = (found.where("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect())
    flat = np.zeros(books.shape[0] * books.shape[1] * (books.shape[2] + 1), np.int64)
    for r in sums:  # parts x entries x (width + 1) numbers
        flat[r["at"]] = r["x"]
    table = flat.reshape(books.shape[0], books.shape[1], books.shape[2] + 1)
    count = table[..., :1]
    return np.where(count > 0, table[..., 1:] // np.maximum(count, 1), books)


def _assign(rows: DataFrame, books: np.ndarray, before: np.ndarray | None, schema: str, sums: bool) -> DataFrame:
    """Codes and errors of ``rows``; with ``sums`` a last row of each task has its counts and sums for each entry."""
    n_parts, n_entries, width = books.shape
    changed = np.ones((n_parts, n_entries), bool) if before is None else (books != before).any(axis=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, out = np.zeros((n_parts, n_entries, width + 1), np.int64), None
        step = max(1, SLICE_VALUES // max(1, n_parts * width))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, n_parts * width)
                if x.size and max(x.max(), -x.min()) > LIMIT:
                    raise ValueError(f"components beyond {LIMIT} don't fit")
                old = None
                if batch.column("codes").null_count == 0 and batch.num_rows:
                    old = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, n_parts)
                codes, error = np.zeros((batch.num_rows, n_parts), np.uint8), np.zeros(batch.num_rows, np.int64)
                for p in range(n_parts):
                    part = x[:, p * width:(p + 1) * width]
                    code, distance = nearest(part, books[p]) if old is None else ball_nearest(part, books[p], old[:, p].astype(np.int64), changed[p])
                    codes[:, p], error = code, error + distance
                    if sums:
                        table[p, :, 0] += np.bincount(code, minlength=n_entries)
                        np.add.at(table[p, :, 1:], code, part)
                out = [batch.column("id").type, batch.column("label").type, batch.column("v").type]
                packed = pa.array([row.tobytes() for row in codes], pa.binary())
                yield _batch(batch.column("id"), batch.column("label"), batch.column("v"), packed, pa.array(error), pa.nulls(batch.num_rows, pa.list_(pa.int64())))
        if sums and out:
            yield _batch(*[pa.nulls(1, t) for t in out], pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([table.reshape(-1).tolist()], pa.list_(pa.int64())))

    return rows.mapInArrow(run, f"{schema}, v array<long>, codes binary, error long, sums array<long>")


def _batch(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["id", "label", "v", "codes", "error", "sums"])


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, compared with all."""
    best, code = _squared(x, entries[0]), np.zeros(len(x), np.int64)
    for k in range(1, len(entries)):
        d = _squared(x, entries[k])
        closer = d < best
        best[closer], code[closer] = d[closer], k
    return code, best


def ball_nearest(x: np.ndarray, entries: np.ndarray, old: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from the entries of the round before: ``old`` code of each row, and which entries have ``changed`` since."""
    best, code = np.zeros(len(x), np.int64), old.copy()
    gaps = _squared(entries[:, None, :], entries[None, :, :])
    order = np.argsort(old, kind="stable")
    ends = np.searchsorted(old[order], np.arange(len(entries) + 1))
    for i in range(len(entries)):
        ball = order[ends[i]:ends[i + 1]]
        if not len(ball):
            continue
        own = _squared(x[ball], entries[i])
        best[ball] = own
        others = np.flatnonzero(np.arange(len(entries)) != i)
        near = others[gaps[i, others] <= 4 * own.max()]
        if not len(near) or not (changed[i] or changed[near].any()):
            continue
        near = near[np.argsort(gaps[i, near], kind="stable")]
        ring = np.searchsorted(gaps[i, near], 4 * own, side="right")  # 0: the stable core
        outward = np.argsort(-ring, kind="stable")
        ball, ring = ball[outward], ring[outward]
        for k, j in enumerate(near):
            reached = ball[:np.searchsorted(-ring, -k, side="left")]  # rings beyond the k-th
            if not len(reached):
                break
            d = _squared(x[reached], entries[j])
            closer = (d < best[reached]) | ((d == best[reached]) & (j < code[reached]))
            best[reached[closer]], code[reached[closer]] = d[closer], j
    return code, best


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)
