"""Hard-negative mining: integer inner products of anchors with all rows by Strassen multiplication, kept in mergeable heaps.

Vectors become integers. Rows are packed in blocks of a few hundred vectors; the anchors (a stated query set) in blocks of
their own. Blocks meet on a grid: anchor blocks are dealt to grid rows and candidate blocks to grid columns, each block is
copied to the cells of its row or column, and a cell joins its anchors with its candidates, so a task holds a few blocks
whatever the size of the table or of a label. A tile (anchors x candidates) is multiplied in int64 by Strassen's recursion: seven
products of half tiles, zero padding of odd sides, additions modulo 2^64, which are exact as long as the scores themselves fit.

Two passes: in the first, tiles of equal labels fill for each anchor a heap of its best same-label rows; the heaps of all cells are
merged into the anchor's positives, each with a window of scores its negatives may have. In the second, whole tiles fill a heap for
each window with the best different-label rows in it, merged likewise. Heaps hold the best few (score, id), higher scores first, ties by
smaller id, and are merged within a cell and again by Spark, so each cell hands on a few rows an anchor.

Defined results: rows with a null id, a null label, a null vector or null or non-finite components take no part; vectors of
different lengths are padded with zeros, an empty vector scores 0; a row is never its own positive, nor is a row with the same id; candidates of one
anchor that agree in id and score count once; repeated anchor rows count once, while anchors that share an id but not label and vector are
mined each on its own; fewer rows than asked for give all; an empty table gives no rows; other columns are ignored. Components over 2^22
in magnitude (after scaling) are an error, since scores in percent would not fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.llm.common import stored
from scorelens.llm.compression import integers, usable

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
LOWEST, HIGHEST = 50, 95  # a negative's score in percent of the positive's
BLOCK, LEAF = 512, 64  # rows of a block; sides at which the recursion multiplies directly
CELL_ANCHORS, CELL_ROWS = 4_096, 8_192  # of a grid cell, on average
LIMIT = 1 << 22

_BLOCKS = "block long, n int, width int, ids binary, labels binary, v binary"
_NONE = np.iinfo(np.int64).min + 1  # its negative fits too


@dataclass(frozen=True)
class Rule:
    """What is mined: how many positives and negatives, and the window of scores in percent."""

    positives: int = POSITIVES
    negatives: int = NEGATIVES
    lowest: int = LOWEST
    highest: int = HIGHEST


def mine(df: DataFrame, anchor: Column, label: Column | None = None, rule: Rule = Rule(), scale: int = SCALE,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for all anchors.

    ``anchor`` chooses the anchors and ``label`` makes the label, both over the columns ``id`` and ``label``.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
    rows = (rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
            .select("id", (F.col("label") if label is None else label).cast("long").alias("label"), integers(F.col("vector"), scale).alias("v")))
    candidates = stored(_blocks(rows), "negative_blocks")
    anchors = stored(_blocks(rows.where(anchor).dropDuplicates(["id", "label", "v"])), "anchor_blocks")
    n = {name: t.agg(F.sum("n")).first()[0] or 0 for name, t in (("anchors", anchors), ("rows", candidates))}
    lines, columns = max(1, -(-n["anchors"] // CELL_ANCHORS)), max(1, -(-n["rows"] // CELL_ROWS))

    heaps = _on_grid(anchors, candidates, lines, columns, _positives(rule), "block long, at int, anchor long, score long, other long")
    best = Window.partitionBy("block", "at").orderBy(F.desc("score"), "other")  # the heaps of one anchor, one from each column of the grid
    positives = stored(heaps.distinct().withColumn("place", F.row_number().over(best)).where(F.col("place") <= rule.positives), "positives")
    of_block = positives.groupBy("block").agg(F.collect_list(F.struct("at", "place", "score", "other")).alias("positives"))  # at most BLOCK anchors' heaps
    found = _on_grid(anchors.join(of_block, "block"), candidates, lines, columns, _negatives(rule),
                     "block long, at int, anchor long, place int, positive long, positive_score long, score long, other long")
    best = Window.partitionBy("block", "at", "place").orderBy(F.desc("score"), "other")
    return (found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= rule.negatives)
            .select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows packed by (id, label, vector); within a block ids ascend."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, labels = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label"))
                lists = part.column("v")
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if flat.size and max(flat.max(), -flat.min()) > LIMIT:
                    raise ValueError(f"components beyond {LIMIT} don't fit")
                size = np.diff(lists.offsets.to_numpy())
                width = int(size.max()) if len(size) else 0
                v = np.zeros((len(ids), width), np.int64)
                v[np.arange(width) < size[:, None]] = flat
                order = np.argsort(ids, kind="stable")
                yield pa.RecordBatch.from_pylist([{"block": block, "n": len(ids), "width": width, "ids": ids[order].tobytes(),
                                                   "labels": labels[order].tobytes(), "v": v[order].tobytes()}], _arrow(_BLOCKS))
                block += 1

    return rows.mapInArrow(run, _BLOCKS)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _on_grid(anchors: DataFrame, candidates: DataFrame, lines: int, columns: int, make, schema: str) -> DataFrame:
    """Every anchor block beside every candidate block, cell by cell; ``make`` gives a cell's heaps."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("line", F.pmod(F.xxhash64("block"), F.lit(lines)).cast("int")).withColumn("column", every(columns))
    right = candidates.withColumn("column", F.pmod(F.xxhash64("block"), F.lit(columns)).cast("int")).withColumn("line", every(lines))

    def run(mine: pa.Table, others: pa.Table) -> pa.Table:
        heaps = make()
        for block in mine.to_pylist():  # a cell's blocks
            for k in range(others.num_rows):
                heaps.add(block, others.slice(k, 1).to_pylist()[0])
        return heaps.handed(_arrow(schema))

    return left.groupBy("line", "column").cogroup(right.groupBy("line", "column")).applyInArrow(run, schema)


def _positives(rule: Rule):
    return lambda: _Positives(rule)


def _negatives(rule: Rule):
    return lambda: _Negatives(rule)


class _Heaps:
    """The heaps of a cell's anchor blocks: arrays (anchors, heaps an anchor, places) of scores and ids."""

    def __init__(self, rule: Rule):
        self.rule, self.blocks = rule, {}

    def add(self, anchors: dict, others: dict) -> None:
        ids, labels, a = _block(anchors)
        if anchors["block"] not in self.blocks:
            self.blocks[anchors["block"]] = self.empty(anchors, ids)
        self.fill(self.blocks[anchors["block"]], ids, labels, a, *_block(others))

    def merge(self, own: dict, rows, heap: int, score: np.ndarray, other: np.ndarray) -> None:
        """The best of what the heaps of ``rows`` hold and of new (score, id) columns, equal ones once."""
        places = own["score"].shape[2]
        score, other = np.concatenate([own["score"][rows, heap], score], axis=1), np.concatenate([own["other"][rows, heap], other], axis=1)
        order = np.lexsort((other, -score), axis=1)
        score, other = np.take_along_axis(score, order, 1), np.take_along_axis(other, order, 1)
        again = np.zeros(score.shape, bool)
        again[:, 1:] = (score[:, 1:] == score[:, :-1]) & (other[:, 1:] == other[:, :-1]) & (score[:, 1:] != _NONE)
        order = np.argsort(again, axis=1, kind="stable")[:, :places]
        score, other = np.where(again, _NONE, score), other
        own["score"][rows, heap], own["other"][rows, heap] = np.take_along_axis(score, order, 1), np.take_along_axis(other, order, 1)


def _block(packed: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    read = lambda name: np.frombuffer(packed[name], np.int64)
    return read("ids"), read("labels"), read("v").reshape(packed["n"], packed["width"])


class _Positives(_Heaps):
    def empty(self, anchors: dict, ids: np.ndarray) -> dict:
        shape = (len(ids), 1, self.rule.positives)
        return {"ids": ids, "score": np.full(shape, _NONE), "other": np.zeros(shape, np.int64)}

    def fill(self, own, ids, labels, a, c_ids, c_labels, c) -> None:
        for label in np.intersect1d(labels, c_labels):
            rows, columns = np.flatnonzero(labels == label), np.flatnonzero(c_labels == label)
            scores = product(a[rows], c[columns])
            scores[ids[rows, None] == c_ids[columns]] = _NONE
            self.merge(own, rows, 0, *best(scores, c_ids[columns], self.rule.positives))

    def handed(self, schema: pa.Schema) -> pa.Table:
        out = [[] for _ in schema.names]
        for block, own in self.blocks.items():
            at, _, place = np.nonzero(own["score"] != _NONE)
            for values, column in zip(out, (np.full(len(at), block), at, own["ids"][at], own["score"][at, 0, place], own["other"][at, 0, place]), strict=True):
                values.append(column)
        return _columns(out, schema)


class _Negatives(_Heaps):
    def empty(self, anchors: dict, ids: np.ndarray) -> dict:
        n, rule = len(ids), self.rule
        own = {"ids": ids, "score": np.full((n, rule.positives, rule.negatives), _NONE), "other": np.zeros((n, rule.positives, rule.negatives), np.int64),
               "positive": np.zeros((n, rule.positives), np.int64), "wanted": np.full((n, rule.positives), _NONE)}
        for p in anchors["positives"]:
            own["wanted"][p["at"], p["place"] - 1], own["positive"][p["at"], p["place"] - 1] = p["score"], p["other"]
        return own

    def fill(self, own, ids, labels, a, c_ids, c_labels, c) -> None:
        scores = product(a, c)
        scores[labels[:, None] == c_labels] = _NONE
        for k in range(self.rule.positives):
            wanted = own["wanted"][:, k, None]
            inside = (wanted != _NONE) & (scores != _NONE)
            percent = np.where(inside, wanted, 0)
            inside &= (self.rule.lowest * percent <= 100 * np.where(inside, scores, 0)) & (100 * np.where(inside, scores, 0) <= self.rule.highest * percent)
            rows = np.flatnonzero(inside.any(axis=1))
            if len(rows):
                self.merge(own, rows, k, *best(np.where(inside[rows], scores[rows], _NONE), c_ids, self.rule.negatives))

    def handed(self, schema: pa.Schema) -> pa.Table:
        out = [[] for _ in schema.names]
        for block, own in self.blocks.items():
            at, heap, place = np.nonzero(own["score"] != _NONE)
            for values, column in zip(out, (np.full(len(at), block), at, own["ids"][at], heap + 1, own["positive"][at, heap], own["wanted"][at, heap],
                                            own["score"][at, heap, place], own["other"][at, heap, place]), strict=True):
                values.append(column)
        return _columns(out, schema)


def _columns(parts: list[list[np.ndarray]], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(np.concatenate(p) if p else np.zeros(0, np.int64), f.type) for p, f in zip(parts, schema, strict=True)], schema=schema)


def best(scores: np.ndarray, ids: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's best ``places`` different (score, id); ``ids`` ascend, so the first of equal scores has the smallest id."""
    scores = scores.copy()
    top, other, rows = [], [], np.arange(len(scores))
    for _ in range(min(places, scores.shape[1])):
        at = scores.argmax(axis=1)
        score = scores[rows, at]
        top.append(score)
        other.append(np.where(score == _NONE, 0, ids[at]))
        scores[(scores == score[:, None]) & (ids == ids[at][:, None])] = _NONE
    return np.stack(top, axis=1), np.stack(other, axis=1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of ``a`` with those of ``b``; the narrower is padded with zeros."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    return strassen(a, np.ascontiguousarray(b.T))


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` in int64 with seven products of halves; sums wrap modulo 2^64, so the result is exact wherever it fits."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf // 2 or max(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    (i, j), h = (a.shape[0] // 2, a.shape[1] // 2), b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    p1, p2 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf)
    p3, p4 = strassen(a11, b12 - b22, leaf), strassen(a22, b21 - b11, leaf)
    p5, p6 = strassen(a11 + a12, b22, leaf), strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    c = np.empty((2 * i, 2 * h), np.int64)
    c[:i, :h], c[:i, h:] = p1 + p4 - p5 + p7, p3 + p5
    c[i:, :h], c[i:, h:] = p2 + p4, p1 - p2 + p3 + p6
    return c[:m, :n]
