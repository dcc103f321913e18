"""What is fitted or compared takes in all rows: beyond the sizes that earlier samples and runs were cut to."""

import random

import numpy as np
from pyspark.sql import functions as F

from scorelens.llm import license_scan, line_dedup, quality
from scorelens.llm.ranks import order_statistics


def test_order_statistics_equal_sorted_columns(spark):
    rng = np.random.default_rng(1)
    columns = [rng.lognormal(0, 8, 5000), np.repeat([0.0, 1e-300, 7.0], [4000, 1, 2]), rng.integers(0, 5, 300) / 3, np.array([2.5])]
    rows = spark.createDataFrame([(k, float(v)) for k, c in enumerate(columns) for v in c], "name int, value double")
    wanted = {k: [0, len(c) // 2, len(c) - 1] for k, c in enumerate(columns)}
    found = order_statistics(rows, wanted)
    assert found == {(k, r): np.sort(columns[k])[r] for k, ranks in wanted.items() for r in ranks}


def test_quality_is_standardised_and_cut_by_all_labelled_rows(spark):
    n = 45_000  # rows; earlier 20,000 labelled ones were drawn
    ids = spark.range(n).withColumnRenamed("id", "key")
    shares = [(F.pmod(F.xxhash64(F.lit(f), "key"), F.lit(100_003)) / 100_003).alias(f) for f in quality.FEATURES]
    figures = ids.select(F.col("key").alias("id"), (F.lit(20) + F.col("key") % 50).alias("n_words"), *shares, F.lit(False).alias("base_failed")).cache()
    labels = ids.select(F.col("key").alias("doc_id"), (F.col("key") % 20 > 0).cast("int").alias("quality"))
    forest, cut = quality.fit(figures, labels, trees=5, sample=64, max_good_loss=0.01)
    rows = figures.toPandas()
    values, good = rows[list(quality.FEATURES)].to_numpy(), (rows["id"] % 20 > 0).to_numpy()
    centre = np.median(values[good], axis=0)
    spread = np.quantile(np.abs(values[good] - centre), quality.USUAL, axis=0)
    assert (forest.centre == centre).all() and (forest.spread == np.maximum(spread, 1 / np.median(rows["n_words"][good]))).all()
    depth = forest.depth(values)
    assert cut == quality.calibrated(depth[good], depth[~good], 0.01)


def test_thresholds_of_tables_equal_those_of_arrays(spark):
    rng = random.Random(3)
    for n_good, n_bad, loss in ((0, 3, 0.1), (40, 0, 0.1), (40, 0, 0.001), (1, 1, 0.0), (200, 30, 0.05), (200, 30, 0.0)):
        good, bad = [float(rng.randint(0, 60)) for _ in range(n_good)], [float(rng.randint(-20, 40)) for _ in range(n_bad)]
        paths = spark.createDataFrame([(1, v) for v in good] + [(0, v) for v in bad], "good int, path_length double")
        assert quality.threshold(paths, loss) == quality.calibrated(np.array(good), np.array(bad), loss)


def test_all_nodes_of_a_large_key_meet(spark):
    rng = random.Random(5)
    sizes = {k: rng.randint(40, 400) for k in range(300)}
    rows = [(k, size, [7, rng.randint(1, 1 << 30), 0, 0]) for k, size in sizes.items()]
    nodes = spark.createDataFrame(rows + rows[:50], "node long, size int, keys array<int>")
    found = [r["nodes"] for r in line_dedup.key_buckets(nodes, 2, 16).collect()]
    met = {(a, b) for part in found for a in part for b in part if a < b}
    assert all((a, b) in met for a in sizes for b in sizes if a < b and min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b]))
    assert max(map(len, found)) <= 32


def test_licence_model_and_thresholds_take_in_all_segments(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(300)]
    odd = "software licence copyright holder warranty permission"  # licence-like; shares no three words in a row with a notice
    lines = [f"{odd if k % 200 == 0 else ''} {' '.join(rng.choices(vocabulary, k=6))}" for k in range(9000)]  # earlier about 4,000 were drawn
    docs = spark.createDataFrame([(k, "\n".join(lines[k:k + 3])) for k in range(0, 9000, 3)] + [(-1, lines[5])], "doc_id long, text string")
    seen = {}

    class Counted(license_scan.LogisticRegression):
        def _fit(self, rows):
            seen["prose"] = rows.where("label = 0").count()
            return super()._fit(rows)

    monkeypatch.setattr(license_scan, "LogisticRegression", Counted)
    found = license_scan.segments(docs, "doc_id", "text")
    classifier = license_scan.fit(found)
    marked = found.select("tokens").distinct().withColumn("out", F.pmod(F.xxhash64("tokens", F.lit("none")), F.lit(license_scan.HELD_OUT)) == 0)
    held_out = marked.where("out").cache()
    assert seen["prose"] == marked.where("not out").count() > 8000
    above = classifier.predict(held_out).where((F.col("family") != "none") & F.col("passes")).groupBy("family").count().collect()
    assert all(r["count"] <= license_scan.RATE * held_out.count() for r in above), above
    assert {r["id"]: r["families"] for r in license_scan.scan(docs).where("id < 6").collect()} == {-1: [], 0: [], 3: []}
