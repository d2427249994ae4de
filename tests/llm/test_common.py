import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafmill.llm import common, files


def test_filters_hold_all_keys_and_grow(spark):
    keys = spark.range(300_000).select((F.xxhash64("id")).alias("k"))
    packed = common.key_filter(keys)
    own = keys.toPandas()["k"].to_numpy()
    assert common.in_filter(packed, own).all()
    other = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 100_000)
    assert common.in_filter(packed, other).mean() < 0.15 and 8 * len(packed) >= 8 * 300_000
    assert len(common.key_filter(keys.limit(0))) == common.FILTER_LEAST // 8 and not common.key_filter(keys.limit(0)).any()


@pytest.mark.parametrize("most", [0, 1000])
def test_rows_without_keys(spark, monkeypatch, most):
    """Few keys go to the rows, more go through a filter, to the same end."""
    monkeypatch.setattr(common, "BROADCAST_KEYS", most)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (3, "e")], "id long, `a.b` string")
    left = common.without(rows, spark.createDataFrame([(2,), (9,), (2,)], "id long"), {"id": F.col("id")})
    assert left.columns == rows.columns and sorted(r[1] for r in left.collect()) == ["a", "d", "e"]


def test_frequent_rows_fit(spark):
    counts = spark.range(1, 5001).selectExpr("id AS n")
    assert counts.where(common.frequent(counts, F.col("n"), 5000)).count() == 5000
    kept = counts.where(common.frequent(counts, F.col("n"), 700))
    assert 300 < kept.count() <= 700 and kept.agg(F.max("n")).first()[0] == 5000


def test_shared_folders(spark, tmp_path, monkeypatch):
    with common.scratch(spark):
        inside = common.shared_dir(spark)
        assert inside.startswith("file:/")
        common.stored(spark.range(3), f"{inside}/t")
    with pytest.raises(Exception):
        spark.read.parquet(f"{inside}/t")
    named = [str(tmp_path)]
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: named[0])
    assert common.shared_dir(spark).startswith(f"file:{tmp_path}/sheafmill-")
    with pytest.raises(ValueError):
        files.opened("/no/scheme")
    with files.opened(f"file:{tmp_path}/a/b", "w") as out:
        out.write(b"x")
    assert files.opened(f"file://{tmp_path}/a/b").read() == b"x"
    named[0] = None
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: None)
    assert common.shared_dir(spark).startswith("file:/")  # a local session goes without
    monkeypatch.setattr(spark.sparkContext, "master", "spark://there:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(spark)
