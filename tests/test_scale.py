"""Steps whose cost a row was too high at size: what they move, and that their rows stay the same."""

import glob

from pyspark.sql import functions as F

from scorelens.operators import bootstrap
from scorelens.plans import testdata
from scorelens.sources import files, sinks


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bootstrap_rows_are_not_multiplied_by_their_blocks(spark):
    rows = [("a", 1.0, "x"), ("a", None, "y"), (None, 3.0, None), (None, 5.0, "z"), ("b", None, "w"), ("a", 1.0, "x")]
    df = spark.createDataFrame(rows, "k string, v double, row string")
    found = bootstrap.replicate_means(df, ["k"], ["v"], F.col("row"), 16, salt="s")
    assert "Generate explode" not in plan_of(found) and "explode(sequence" not in plan_of(found)
    got = {r["k"]: r["v"] for r in found.collect()}
    counts = bootstrap._counts()

    def drawn(row, replicate):
        import hashlib
        digest = hashlib.md5(":".join(["s", *([] if row is None else [row]), str(replicate // 8)]).encode()).hexdigest()
        k = replicate % 8
        return counts[int(digest[15 * (k // 4):15 * (k // 4) + 15], 16) >> 15 * (k % 4) & 32767]

    for key in ("a", "b", None):
        means = []
        for replicate in range(16):
            weighted = [(drawn(row, replicate), v) for k, v, row in rows if k == key and v is not None]
            if sum(w for w, _ in weighted):
                means.append(sum(w * v for w, v in weighted) / sum(w for w, _ in weighted))
        assert got[key] == sorted(means)


def test_json_array_files_take_one_shuffle_and_may_be_compressed(spark, tmp_path):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("file"), F.lit("text " * 50).alias("t"))
    for codec, suffix in ((None, ".txt"), ("gzip", ".gz")):
        path = str(tmp_path / f"out-{codec}")
        sinks.write_json_array_files(df, path, "file", order=["id"], compression=codec)
        parts = glob.glob(f"{path}/file=*/part-*")
        assert len(parts) == 7 and all(p.endswith(suffix) for p in parts)
        back = files.read_json_nested(spark, path, "id long, t string")
        assert sorted(r["id"] for r in back.collect()) == list(range(500))


def test_trainer_states_sort_no_derived_fields(spark, monkeypatch):
    seen = []
    number = testdata.with_row_number
    monkeypatch.setattr(testdata, "with_row_number", lambda df, order: seen.append(df.columns) or number(df, order))
    testdata.trainer_states(spark, "/root/testdata/sf0.001").limit(1).collect()
    assert seen and all(c.startswith("l_") for c in seen[0])
