import random

from pyspark.sql import functions as F

from sheafmill.operators import prefix, windows


def test_hashed_keys_spread_over_buckets(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("key"), (F.col("id") % 7).alias("v"))
    sizes = [r["count"] for r in rows.groupBy(prefix.buckets(rows, F.col("key").cast("double"), 1000)).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1300
    got = prefix.running_sum(rows, "key", F.col("v"), "before", span=1000).orderBy("key").collect()
    total = 0
    for r in got:
        assert r.before == total
        total += r.v


def test_sums_within_groups_and_of_few_rows(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("ab"), rng.choice([None, 1, 5])) for k in rng.sample(range(-(1 << 62), 1 << 62, 1 << 40), 300)]
    got = prefix.running_sum(spark.createDataFrame(rows, "key long, g string, v int"), "key", F.col("v"), "before", ("g",), span=16).collect()
    assert all(r.before == sum(v or 0 for k, g, v in rows if g == r.g and k < r.key) for r in got) and len(got) == 300
    one = spark.createDataFrame([(5, 3)], "key long, v int")
    assert [r.b for r in prefix.running_sum(one, "key", F.col("v"), "b").collect()] == [0]
    assert prefix.running_sum(one.limit(0), "key", F.col("v"), "b").count() == 0


def test_texts_are_ranked_in_order(spark):
    rng = random.Random(2)
    names = sorted({"file:/data/é/" + "".join(rng.choice("abé日/.") for _ in range(rng.randint(1, 12))) for _ in range(3000)}, key=str.encode)
    rows = spark.createDataFrame([(n,) for n in rng.sample(names, len(names))], "path string")
    got = prefix.row_rank(rows, "path", "rank", span=200, place=prefix.text_place(rows, "path")).collect()
    assert {r.path: r["rank"] for r in got} == {n: k for k, n in enumerate(names)}


def test_chunks_of_sorted_rows(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, 1, 1, 1, 9, 4])) for k in range(500)]
    got = windows.sorted_chunks(spark.createDataFrame(rows, "id long, area int"), "area", "id", 7).collect()
    order = [k for _, k in sorted((a or 0, k) for k, a in rows)]
    assert {r.id: r.chunk_id for r in got} == {k: at // 7 for at, k in enumerate(order)}
