import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheafmill.functions import scalar
from sheafmill.operators import compare, filters, models, reports, routing


def test_noise_rules(spark):
    rows = [(n, s, w) for n in (*filters.NOISE, "word", None) for s in (0.49, 0.79, 0.80, 0.81) for w in (4, 5, 6)]
    items = spark.createDataFrame([(k, n, s, (0, 0, w, 5)) for k, (n, s, w) in enumerate(rows)], "item_idx int, text string, score double, bbox struct<x0:int,y0:int,x1:int,y1:int>")
    got = {r.item_idx for r in filters.without_noise(items, 0.5).collect()}
    want = {k for k, (n, s, w) in enumerate(rows) if not (s < 0.5 or (n in filters.NOISE and s < 0.8 and w < 5))}
    assert got == want
    assert len(filters.NOISE) == 21


def test_formula_filters_and_null_labels(spark):
    items = spark.createDataFrame([(1, "inline_formula", None), (2, "display_formula", "x"), (3, None, None), (4, "seal", None)], "item_idx int, label string, latex string")
    assert sorted((r.item_idx, r.latex) for r in filters.formulas(items).collect()) == [(1, ""), (2, "x")]
    assert sorted(r.item_idx for r in filters.without_inline_formulas(items).collect()) == [2, 3, 4]


def test_wired_routing(spark):
    rows = [("WirelessTable", 0.89, ["a"]), ("WirelessTable", 0.9, ["a"]), ("WiredTable", 0.99, ["a"]), ("WiredTable", 0.1, None), ("WiredTable", 0.1, []), (None, None, ["a"])]
    tables = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "table_id int, cls_label string, cls_score double, ocr_result array<string>")
    kept = filters.wired_tables(tables)
    assert sorted(r.table_id for r in kept.collect()) == [0, 2] and kept.columns == ["table_id", "ocr_result"]


def test_zip_checks_lengths(spark):
    frame = spark.createDataFrame([([1, 2], ["a", "b"])], "a array<int>, b array<string>")
    assert [tuple(p) for p in frame.select(routing.zipped(F.col("a"), F.col("b")).alias("z")).first().z] == [(1, "a"), (2, "b")]
    bad = spark.createDataFrame([([1, 2], ["a"])], "a array<int>, b array<string>")
    with pytest.raises(Exception, match="differ in length"):
        bad.select(routing.zipped(F.col("a"), F.col("b"))).collect()


def test_points_and_overlaps_equal_brute_force(spark):
    rng = random.Random(1)
    box = lambda: (x := rng.randint(0, 400), y := rng.randint(0, 400), x + rng.randint(0, 300), y + rng.randint(0, 300))
    kind = "page int, id int, bbox struct<x0:int,y0:int,x1:int,y1:int>"
    a, b = ([(rng.randint(0, 2), k, box()) for k in range(60)] for _ in range(2))
    points = [(rng.randint(0, 2), k, rng.randint(0, 700), rng.randint(0, 700)) for k in range(300)]
    regions, boxes = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    got = sorted((r.page, r.region.id, r.box.id) for r in routing.overlapping(regions, boxes, "page").collect())
    meets = lambda p, q: max(p[0], q[0]) < min(p[2], q[2]) and max(p[1], q[1]) < min(p[3], q[3])
    assert got == sorted((p, i, j) for p, i, x in a for q, j, y in b if p == q and meets(x, y))
    inside = routing.masked_points(spark.createDataFrame(points, "page int, id int, x int, y int"), boxes, "page")
    assert sorted(r.id for r in inside.collect()) == sorted(k for p, k, x, y in points if any(p == q and c[0] <= x < c[2] and c[1] <= y < c[3] for q, _, c in b))


def test_tables_gather_their_lines(spark):
    tables = spark.createDataFrame([(1,), (2,)], "table_id int")
    lines = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (9, 1, "x")], "table_id int, k int, text string")
    rows = routing.appended(tables, lines, ["table_id"], "k", ["text"]).orderBy("table_id").collect()
    assert [[c.text for c in r.ocr_result] for r in rows] == [["a", "b"], []]


def test_line_diff_equals_the_formula(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    ends = ["", "\n", "\r\n", "\n\n", "\x0b", "\x85", "\u2028", "\r"]
    pairs = [(k, texts[k] + rng.choice(ends), rng.choice(ends) + texts[-k - 1]) for k in range(200)] + [(200, None, "a"), (201, "", ""), (202, "a\n", "a"), (203, "", "a"), (204, "\n", "")]
    got = {r.k: r.n for r in spark.createDataFrame(pairs, "k int, a string, b string").select("k", compare.differing_lines(F.col("a"), F.col("b")).alias("n")).collect()}
    for k, a, b in pairs:
        x, y = (a or "").splitlines(), (b or "").splitlines()
        assert got[k] == (None if a is None else sum(p != q for p, q in zip(x, y)) + abs(len(x) - len(y)))


def test_stage_report_rest_is_never_negative(spark):
    timings = spark.createDataFrame([("a", 10.0), ("a", 30.0), ("b", 60.0)], "stage string, wall_ms double")
    total = lambda v: spark.createDataFrame([(v,)], "total_ms double")
    rows = lambda f: {r.stage: (r.calls, r.wall_ms, r.pct) for r in f.collect()}
    assert rows(reports.stage_report(timings)) == {"a": (2, 40.0, 40.0), "b": (1, 60.0, 60.0)}
    assert rows(reports.stage_report(timings, total(200.0)))["other"] == (1, 100.0, 50.0)
    assert rows(reports.stage_report(timings, total(50.0)))["other"] == (1, 0.0, 0.0)
    assert "other" not in rows(reports.stage_report(timings, total(None)))
    assert reports.stage_report(timings.limit(0)).count() == 0


def test_run_summary_of_nothing(spark):
    runs = spark.createDataFrame([], "pages int, process_ms double")
    assert tuple(reports.run_summary(runs).first()) == (0, 0, 0.0, 0.0, 0.0)


def test_rounding_is_that_of_the_binary_value(spark):
    rng = random.Random(3)
    values = [k / 1000 for k in range(-50, 1001)] + [k / 10_000 + 5e-5 for k in range(2000)] + [rng.uniform(-9, 9) for _ in range(500)] + [0.125, 0.375, 2.5, 1e15 + 0.3, -0.0, float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", scalar.rounded(F.col("x"), 2).alias("two"), scalar.rounded(F.col("x"), 3).alias("three")).collect()
    assert [(r.two, r.three) for r in rows] == [(round(v, 2), float(f"{v:.3f}")) for v in values]


def test_decoder_pads_and_ends():
    hidden = np.array([[3.0], [1.0], [6.0]])
    ids = models.greedy_decode(hidden, models.stub_step(), eos=1, pad=99, max_len=10, max_batch=2)
    assert ids.tolist() == [[0, 3, 2, 1, 99, 99, 99], [0, 1, 99, 99, 99, 99, 99], [0, 6, 5, 4, 3, 2, 1]]
    cut = models.greedy_decode(np.array([[9.0]]), models.stub_step(), eos=1, pad=99, max_len=3)
    assert cut.tolist() == [[0, 9, 8, 7]]
    assert models.greedy_decode(np.zeros((0, 1)), models.stub_step(), 1, 99, 3).shape[0] == 0


def test_fallback_and_result_counts(spark):
    def broken(rows):
        raise RuntimeError

    double = lambda rows: pd.DataFrame({"y": rows.x * 2})
    rows = pd.DataFrame({"x": [1, 2]})
    assert models.with_fallback(broken, double)(rows).used_fast.tolist() == [False, False]
    assert models.with_fallback(lambda r: None, double)(rows).y.tolist() == [2, 4]
    assert models.with_fallback(double, broken)(rows).used_fast.tolist() == [True, True]
    out = models.apply_model(spark.range(100).withColumnRenamed("id", "x"), ("t",), lambda: double, "y long", batch=7)
    assert sorted(r.y for r in out.collect()) == list(range(0, 200, 2))
    assert models.ctc_text([1, 1, 0, 1, 2, 2], "ab") == "aab"


def test_routes_and_checks(spark):
    rows = pd.DataFrame({"x": [1, 200, 3, 400]})
    double, minus = (lambda r: pd.DataFrame({"y": r.x.to_numpy() * 2})), (lambda r: pd.DataFrame({"y": -r.x.to_numpy()}))
    out = models.routed(double, minus, lambda r: r.x < 100)(rows)
    assert out.y.tolist() == [2, -200, 6, -400] and out.used_fast.tolist() == [True, False, True, False]
    assert models.routed(double, minus, lambda r: r.x < 100)(rows[:0]).y.tolist() == []
    models.expect_shapes({"hidden": (2, 144, 8)}, {"hidden": (None, 144, None)})
    for shapes in ({"hidden": (2, 9)}, {}, {"hidden": (2, 143, 8)}):
        with pytest.raises(ValueError, match="hidden"):
            models.expect_shapes(shapes, {"hidden": (None, 144, None)})
    frame = spark.range(1)
    assert models.expect_columns(frame, "id long") is frame
    with pytest.raises(ValueError, match="label string"):
        models.expect_columns(frame, "id long, label string")


def test_batches_that_span_frames(spark):
    """Small Arrow frames cut batches in two; a null key makes a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, None if k % 10 == 9 else "ab"[k % 2], (k // 10) % 3) for k in range(200)]
        model = lambda: lambda part: pd.DataFrame({"n": [len(part)] * len(part), "first": [part.id.min()] * len(part)})
        made = models.apply_in_batches(spark.createDataFrame(rows, "id long, lang string, batch int"), ["lang", "batch"], ["id"], ("b",), model, "n long, first long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(made) == 200
    for r in made:
        own = [k for k, lang, batch in rows if (lang, batch) == (r.lang, r.batch)]
        assert (r.n, r.first) == (len(own), min(own))


def test_sizes(spark):
    rows = spark.createDataFrame([(k, h, w) for k, (h, w) in enumerate([(16, 48), (80, 1), (1000, 2000), (960, 960), (10, 10)])], "k int, h int, w int")
    got = [(r.s.h, r.s.w) for r in rows.select("k", scalar.det_size(F.col("h"), F.col("w")).alias("s")).orderBy("k").collect()]

    def want(h, w):
        r = 960 / max(h, w) if max(h, w) > 960 else 1
        return tuple(max(round(int(x * r) / 32) * 32, 32) for x in (h, w))

    assert got == [want(16, 48), want(80, 1), want(1000, 2000), want(960, 960), want(10, 10)]
    box = F.struct(F.lit(-5).alias("x0"), F.lit(2).alias("y0"), F.lit(50).alias("x1"), F.lit(9).alias("y1"))
    one = spark.range(1)
    assert tuple(one.select(scalar.clamp_box(box, 20, 20).alias("b")).first().b) == (0, 2, 20, 9)
    assert one.select(scalar.clamp_box(box, 20, 2).alias("b")).first().b is None
