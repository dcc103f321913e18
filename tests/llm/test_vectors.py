"""Code compression, hard negatives and sharding against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelens.llm import compression, hard_negatives, sharding
from scorelens.session import scratch_path

VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, codes string, error long, block int"
DOCS = "doc_id long, text string, size string, shard int, range long, h1 string, `row` int"


def vectors(n, dims, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (5, dims))
    out = [(k, [float(np.float32(x)) for x in centres[k % 5] + rng.normal(0, 0.1, dims)], k % 4) for k in range(n)]
    out += [out[3], out[3], (n, out[4][1], None), (n + 1, None, 2), (n + 2, [None] * dims, 1), (n + 3, [float("nan")] * dims, 1),
            (n + 4, [float("-inf")] * dims, 1), (None, out[5][1], 2), (n + 7, [0.0] * dims, 3)]
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3) for r in vectors(300, 16)], VECTORS).repartition(5).cache()


def ints(rows, scale):
    return [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]


# --- 11 code compression


def lloyd(rows, parts, entries, rounds):
    kept = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    first, seen = [], set()
    for i, v, _ in kept:
        if i not in seen and len(first) < entries:
            first.append(v)
            seen.add(i)
    width = len(first[0]) // parts
    books = [[f[p * width:(p + 1) * width] for f in first] for p in range(parts)]

    def closest(p, v):
        part = v[p * width:(p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        own = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in kept:
            for p in range(parts):
                own[p][closest(p, v)[1]].append(v[p * width:(p + 1) * width])
        books = [[[sum(c) // len(c) for c in zip(*own[p][k], strict=True)] if own[p][k] else e for k, e in enumerate(books[p])] for p in range(parts)]
    coded = [(i, "".join(f"{closest(p, v)[1]:02x}" for p in range(parts)), sum(closest(p, v)[0] for p in range(parts)), label) for i, v, label in kept]
    return coded, books


def test_codes_equal_plain_lloyd(table):
    found = compression.compress(table, parts=4, entries=6, rounds=4)
    coded, books = lloyd(ints(vectors(300, 16), 4096), 4, 6, 4)
    assert found.codebooks.tolist() == books
    got = [(r["id"], bytes(r["codes"]).hex(), r["error"], r["label"]) for r in found.rows.collect()]
    assert sorted(got, key=repr) == sorted(coded, key=repr)
    total = defaultdict(int)
    for _, _, error, label in coded:
        total[label] += error
    assert {(r["label"], r["label_error"]) for r in compression.with_label_error(found.rows).collect()} == set(total.items())


def test_balls_skip_work_and_change_nothing():
    rng = np.random.default_rng(0)
    for _ in range(30):
        k = int(rng.integers(1, 12))
        x, entries = rng.integers(-9, 9, (400, 3)), rng.integers(-9, 9, (k, 3))  # many ties
        old, _ = compression.nearest(x, entries)
        moved = entries + rng.integers(-2, 3, entries.shape) * rng.integers(0, 2, (k, 1))
        code, distance = compression.ball_nearest(x, moved, old, (moved != entries).any(axis=1))
        want, least = compression.nearest(x, moved)
        assert (code == want).all() and (distance == least).all()
    still = compression.ball_nearest(x, moved, want, np.zeros(k, bool))  # nothing moved: nothing is compared
    assert (still[0] == want).all() and (still[1] == least).all()


def test_compression_of_few_or_no_rows(spark, table):
    none = compression.compress(table.where("1 = 0"))
    assert none.rows.count() == 0 and compression.with_label_error(none.rows).count() == 0 and none.codebooks.size == 0
    two = compression.compress(table.where("vec_id in (1, 3)"), parts=8)  # id 3 three times: two entries
    assert two.codebooks.shape == (8, 2, 2) and two.rows.count() == 4 and two.rows.agg(F.sum("error")).first()[0] == 0
    other = table.unionByName(spark.createDataFrame([(1000, [1.0] * 3, 1, 1, "", "", 1, 1)], VECTORS))  # another length
    assert 1000 not in {r["id"] for r in compression.compress(other, parts=2, rounds=1).rows.collect()}
    with pytest.raises(ValueError):
        compression.compress(table, parts=5)
    codes = two.rows.where("id = 1").first()["codes"]
    assert compression.decode(codes, two.codebooks).tolist() == next(v for i, v, _ in ints(vectors(300, 16), 4096) if i == 1)


# --- 12 hard negatives


def mined(rows, every, rule=hard_negatives.Rule()):
    rows = {(i, label, tuple(v)) for i, v, label in rows if i is not None and label is not None}
    out = []
    for i, label, v in rows:
        if i % every:
            continue
        scores = {(-sum(a * b for a, b in zip(v, w, strict=False)), j, other == label) for j, other, w in rows}
        positives = sorted((s, j) for s, j, same in scores if same and j != i)[:rule.positives]
        for s, j in positives:
            fit = sorted({(t, k) for t, k, same in scores if not same and rule.lowest * -s <= 100 * -t <= rule.highest * -s})
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fit[:rule.negatives])]
    return sorted(out)


@pytest.mark.parametrize("block,cell", [(512, 8192), (16, 40)])
def test_negatives_equal_brute_force(table, monkeypatch, block, cell):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", cell)
    monkeypatch.setattr(hard_negatives, "CELL_ANCHORS", cell // 2)
    got = hard_negatives.mine(table, F.col("id") % 10 == 0).collect()
    want = mined(ints(vectors(300, 16), 256), 10)
    assert len(want) > 100 and sorted(tuple(r) for r in got) == want


def test_strassen_is_exact():
    rng = np.random.default_rng(1)
    for m, k, n, leaf in [(1, 1, 1, 2), (5, 7, 3, 2), (64, 64, 64, 8), (33, 1, 70, 4), (100, 65, 31, 16), (0, 4, 3, 2), (3, 0, 3, 2)]:
        a, b = rng.integers(-2**20, 2**20, (m, k)), rng.integers(-2**20, 2**20, (k, n))
        assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()
    big = rng.integers(-2**31, 2**31, (40, 2))  # half sums wrap, results fit
    assert (hard_negatives.strassen(big, big.T.copy(), 1) == big @ big.T).all()


def test_heaps_keep_ties_by_id_and_equal_rows_once():
    scores = np.array([[5, 5, 7, 5, 7]])
    top, ids = hard_negatives.best(scores, np.array([1, 1, 2, 3, 4]), 4)
    assert top.tolist() == [[7, 7, 5, 5]] and ids.tolist() == [[2, 4, 1, 3]]


def test_negatives_of_odd_tables(spark, table):
    assert hard_negatives.mine(table.where("1 = 0"), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.mine(table, F.lit(False)).count() == 0
    rows = [(0, [1.0, 0.0], 1), (1, [1.0], 1), (2, [0.5, 4.0], 2), (3, [], 2), (2, [0.5, 4.0], 2), (50, [0.0, 0.0], 3), (4, [0.0], 3), (5, [2.0], 4)]
    few = spark.createDataFrame([(*r, 1, "", "", 1, 1) for r in rows], VECTORS)
    got = sorted(tuple(r) for r in hard_negatives.mine(few, F.col("id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 2, 65536, 32768), (50, 4, 1, 0, 0, 0), (50, 4, 2, 1, 0, 0), (50, 4, 3, 2, 0, 0)]


# --- 13 sharding


def documents():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("alpha beta gamma straße ж".split()) for _ in range(rng.randint(1, 80))) for _ in range(600)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, "the same text everywhere") for k in range(400)]
    return rows + [(2000 + k, None) for k in range(5)] + [(2010, ""), (2011, ""), (None, "no id"), (7, texts[7]), (7, texts[7]), (3000, "long " * 300)]


def order(doc):
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    return number(doc[1] or ""), number("" if doc[0] is None else str(doc[0]))


def sharded(rows, shards, law, whole=sharding.WHOLE):
    rows = sorted(rows, key=order)
    size = [len((t or "").encode()) + 1 for _, t in rows]
    start, total = np.concatenate([[0], np.cumsum(size)]).tolist(), sum(size)
    if law == "rows":
        own = [(2 * k + 1) * shards // (2 * len(rows)) for k in range(len(rows))]
    else:
        own = [min(shards - 1, (start[k] + start[k + 1]) * shards // (2 * total)) for k in range(len(rows))]
        groups = defaultdict(list)
        for k, (_, t) in enumerate(rows):
            groups[t or ""].append(k)
        for ks in groups.values():
            weight = sum(size[k] for k in ks)
            if len({own[k] for k in ks}) > 1 and weight * shards * whole <= total:
                for k in ks:
                    own[k] = min(shards - 1, (2 * start[ks[0]] + weight) * shards // (2 * total))
    first = {s: own.index(s) for s in own}
    return sorted((-1 if i is None else i, size[k], zlib.crc32((t or "").encode()), own[k], k - first[own[k]]) for k, (i, t) in enumerate(rows))


@pytest.mark.parametrize("law,ranges,least", [("bytes", 1024, 100), ("rows", 1024, 100), ("bytes", 60, 1), ("bytes", 1, 1)])
def test_shards_equal_brute_force(spark, monkeypatch, law, ranges, least):
    monkeypatch.setattr(sharding, "RANGES", ranges)
    monkeypatch.setattr(sharding, "LEAST_ROWS", least)
    monkeypatch.setattr(sharding, "STEP", 4)
    rows = documents()
    df = spark.createDataFrame([(*r, "s", 1, 2, "h", 3) for r in rows], DOCS).repartition(6)
    got = [(-1 if r["id"] is None else r["id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(df, 8, law).collect()]
    assert sorted(got) == sharded(rows, 8, law)
    per = defaultdict(list)
    for r in got:
        per[r[3]].append(r)
    assert all(sorted(r[4] for r in rs) == list(range(len(rs))) for rs in per.values())
    if law == "rows":
        assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    else:
        sums = [sum(r[1] for r in rs) for rs in per.values()]
        assert max(sums) - min(sums) <= 2 * max(r[1] for r in got) + sum(sums) / 8 / 50


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    """Copies of one text that fill a third of the table end up in many ranges, in the order of their keys."""
    monkeypatch.setattr(sharding, "LEAST_ROWS", 10)
    rows = spark.createDataFrame([(*r, "s", 1, 2, "h", 3) for r in documents()], DOCS)
    text = F.coalesce("text", F.lit(""))
    keyed = rows.select((F.octet_length(text) + 1).cast("long").alias("size"), sharding.md5_long(text).alias("h1"),
                        sharding.md5_long(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h2"),
                        F.monotonically_increasing_id().alias("row"), "text").cache()
    total = keyed.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    placed = sharding._placed(keyed, total, 100).collect()
    per = defaultdict(int)
    for r in placed:
        per[r["range"]] += 1
    assert max(per.values()) < 60 and len({r["range"] for r in placed if r["text"] == "the same text everywhere"}) > 8
    in_order = sorted(placed, key=lambda r: (r["h1"], r["h2"], r["row"]))
    assert [r["range"] for r in in_order] == sorted(r["range"] for r in placed)


def test_no_rows_and_written_shards(spark):
    none = spark.createDataFrame([], DOCS)
    assert sharding.shard(none).count() == 0 and sharding.shard(none, law="rows").count() == 0
    rows = documents()
    df = spark.createDataFrame([(*r, "s", 1, 2, "h", 3) for r in rows], DOCS)
    path = scratch_path(spark, "shards")
    sharding.write_shards(df, path, 4)
    back = spark.read.parquet(path)
    assert sorted((r["record"]["doc_id"] or -1, r["record"]["text"] or "") for r in back.collect()) == sorted((i or -1, t or "") for i, t in rows)
    assert {(r["shard"], r["slot"]) for r in back.collect()} == {(r[3], r[4]) for r in sharded(rows, 4, "bytes")}
    with pytest.raises(ValueError):
        sharding.shard(df, law="key")
