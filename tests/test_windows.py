import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheafmill.operators import prefix, windows


def planned(counts, pages):
    """Windows filled one page after the other."""
    out, held, number = [], 0, 0
    for doc, count in enumerate(counts):
        at = 0
        while at < count:
            take = min(count - at, pages - held)
            out.append((number, doc, at, take))
            at, held = at + take, held + take
            if held == pages:
                number, held = number + 1, 0
    return out


def batched(widths, items, budget):
    out, size = [], 0
    for w in widths:
        if not out or size >= items or (size + 1) * w > budget:
            out.append(0)
            size = 0
        size += 1
        out[-1] += 1
    return out


def test_windows_cover_every_page_once(spark):
    rng = random.Random(3)
    for pages in (1, 7, 64):
        counts = [rng.choice([0, 1, 2, 5, 63, 64, 65, 130]) for _ in range(40)]
        docs = spark.createDataFrame(list(enumerate(counts)), "doc_index long, page_count int")
        got = sorted(tuple(r) for r in windows.plan_windows(docs, pages).select("window_id", "doc_index", "page_start", "take").collect())
        assert got == sorted(planned(counts, pages))


def test_windows_of_empty_and_null_counts(spark):
    docs = spark.createDataFrame([(1, None), (2, 0), (3, -4)], "doc_index long, page_count int")
    assert windows.plan_windows(docs).count() == 0
    assert windows.zero_page_documents(docs).count() == 3
    assert [tuple(r) for r in windows.completion_windows(docs).orderBy("doc_index").collect()] == [(1, 0, None), (2, 0, None), (3, 0, None)]
    assert windows.plan_windows(docs.limit(0)).count() == 0


def test_running_sum_over_several_buckets(spark):
    rows = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = {r.id: r.s for r in prefix.running_sum(rows, "id", F.col("v"), "s", span=13).collect()}
    total = 0
    for k in range(1000):
        assert got[k] == total
        total += k % 7


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([96, 192, 768, 864, 960, 1056, 2496, 2560, 9600]), max_size=60), st.integers(1, 7))
def test_batches_are_the_greedy_ones(spark, widths, items):
    lines = spark.createDataFrame([("a", k, w) for k, w in enumerate(widths)], "lang string, line_id long, w int")
    rows = windows.adaptive_batches(lines, items=items).orderBy("w", "line_id").collect()
    sizes = {}
    for r in rows:
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
        assert r.padded_w == max(x.w for x in rows if x.batch_id == r.batch_id)
    assert [sizes[k] for k in sorted(sizes)] == batched(sorted(widths), items, windows.BUDGET)
    assert len(rows) == len(widths)


def test_chunks_and_ties(spark):
    rows = spark.range(10)
    assert sorted(r.chunk_id for r in windows.fixed_chunks(rows, "id", 4).collect()) == [0] * 4 + [1] * 4 + [2] * 2
