import pandas as pd
from pyspark.sql import functions as F

from sheafmill.operators import stages
from sheafmill.streaming.progress import StageTimer

ITEMS = "doc_index int, page_index int, item_idx int, label string, bbox struct<x0:int,y0:int,x1:int,y1:int>, score double, text string, latex string, html string"
BOX = (10, 20, 110, 60)


def items_of(spark):
    rows = [(1, "inline_formula", BOX), (2, "display_formula", BOX), (3, "text", BOX), (4, "table", (0, 0, 50, 9)), (5, "seal", (5, 5, 30, 30)), (6, "seal", None), (7, None, BOX)]
    return spark.createDataFrame([(0, 0, k, label, box, 1.0, None, None, None) for k, label, box in rows], ITEMS)


def test_formulas_are_decoded_or_dropped(spark):
    items = items_of(spark)
    decode = lambda f: f.where("item_idx = 1").withColumn("latex", F.lit("x^2"))
    got = {r.item_idx: r.latex for r in stages.formula_stage(items, decode).collect()}
    assert got == {1: "x^2", 2: "", 3: None, 4: None, 5: None, 6: None, 7: None}
    assert sorted(r.item_idx for r in stages.formula_stage(items, decode, enabled=False).collect()) == [2, 3, 4, 5, 6, 7]


def reader():
    def read(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"text": [f"line {k}" if k < 4 else "(cid:)" for k in rows.line_id], "score": [0.91251 if k != 2 else 0.1 for k in rows.line_id]})

    return read


def quads(crops):
    """Lines in a crop with a margin of 50: upright, slanted, uncertain, too narrow, and two fragments."""
    q = lambda x0, y0, x1, y1, drop=0: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((x0, y0), (x1, y0 + drop), (x1, y1 + drop), (x0, y1))))
    lines = [(0, q(50, 50, 140, 70)), (1, q(50, 50, 90, 60, 8)), (2, q(50, 50, 140, 70)), (3, q(50, 50, 52, 70)), (4, q(50, 50, 60, 90)), (5, q(50, 50, 140, 70))]
    return crops.withColumn("l", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("line_id"), v.alias("quad")) for k, v in lines)))).select(*stages.KEY, "l.line_id", "l.quad")


def test_lines_come_back_on_their_page(spark):
    pages = spark.createDataFrame([(0, 0, "en", False, 90, 200)], "doc_index int, page_index int, lang string, ocr_enable boolean, width int, height int")
    rows = {r.line_id: r for r in stages.text_stage(items_of(spark), pages, quads, reader).collect()}
    assert sorted(rows) == [0, 1, 4, 5]
    assert tuple(rows[0].bbox) == (10, 20, 90, 40) and rows[0].label == "ocr_text" and rows[0].score == 0.91
    assert tuple(rows[1].bbox) == (10, 24, 50, 34)


def test_tables_seals_and_blocks(spark):
    tables = spark.createDataFrame([(0, 0, 4, "WiredTable", 0.5), (0, 0, 9, "Other", 0.5)], "doc_index int, page_index int, item_idx int, cls_label string, cls_score double")
    cells = spark.createDataFrame([(0, 0, 4, 2, "b<"), (0, 0, 4, 1, "a")], "doc_index int, page_index int, item_idx int, order int, text string")
    inline = cells.where("order = 1").withColumn("order", F.lit(3)).withColumn("text", F.lit("$x$"))
    net = lambda mark: lambda t: t.withColumn("html", F.concat(F.lit(f"{mark}<table>"), F.array_join(F.transform("ocr_result", lambda c: c["text"]), "|"), F.lit("</table>z")))
    made = stages.table_stage(tables, cells, net("w"), net("v"), inline)
    assert {r.item_idx: r.html for r in made.collect()} == {4: "<table>a|b&lt;|$x$</table>", 9: "<table></table>"}
    items = items_of(spark)
    seals = stages.seal_stage(items, lambda s: s.withColumn("seal_texts", F.array(F.lit("A"), F.lit(""))))
    assert [(r.item_idx, r.seal_texts) for r in seals.collect()] == [(5, ["A"])]
    lines = spark.createDataFrame([], "doc_index int, page_index int, label string, bbox struct<x0:int,y0:int,x1:int,y1:int>, text string")
    blocks = stages.page_blocks(items.withColumn("latex", F.lit("l")), lines, made, seals).collect()
    assert [[b.label for b in r.blocks] for r in blocks] == [["table", "seal", "display_formula", "inline_formula"]]


def test_stage_timer_counts_rows(spark):
    timer = StageTimer()
    frame = timer.watch("numbers", spark.range(7))
    timer.time("numbers", frame.collect)
    assert timer.counts() == {"numbers": 7} and timer.rows[0][0] == "numbers" and timer.rows[0][1] > 0
