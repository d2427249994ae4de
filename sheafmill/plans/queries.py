"""One query per operator over stand-in tables, and the same in SQL.

The test tables hold no pages, rasters or layout, so each operator is bound to columns that have the
right shape: a document of `documents` has a page per 200 characters and is a text line as wide as it
has characters; a row of `lineitem` is a layout item; `events` are stage timings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, text
from ..operators import compare, filters, models, reports, routing, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_index"), F.expr("n_chars div 200").alias("page_count"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = scalar.quantize_width(F.col("n_chars")).cast("long")
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_id"), "lang", width.alias("w"), F.lit(48).alias("h"))


_NOISE_SQL = "[" + ", ".join("'" + n + "'" for n in filters.NOISE) + "]"
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
_ITEMS_SQL = f"""
    SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS BIGINT) AS item_idx,
           CASE WHEN l_returnflag = 'A' THEN 'display_formula' WHEN l_returnflag = 'R' THEN 'inline_formula' WHEN l_linestatus = 'O' THEN 'ocr_text' END AS label,
           l_partkey % 800 AS x0, l_suppkey % 1000 AS y0, l_partkey % 800 + 1 + l_orderkey % 190 AS x1, l_suppkey % 1000 + 1 + CAST(floor(l_quantity) AS BIGINT) AS y1,
           1 - l_discount * 4 AS score, l_linenumber AS line, l_partkey AS part FROM lineitem"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout items; a page is an order, which has few."""
    rows = _table(spark, sf_dir, "lineitem")
    rows.createOrReplaceTempView("__items_lineitem")
    items = spark.sql(_ITEMS_SQL.replace("FROM lineitem", "FROM __items_lineitem"))
    bbox = scalar.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    noise = F.array(*(F.lit(n) for n in filters.NOISE))
    texts = F.coalesce(F.get(noise, (F.col("part") % 30).cast("int")), F.lit("text"))
    return items.select("page", "item_idx", "label", bbox.alias("bbox"), "score", texts.alias("text"), "line", "part")


_DOCS = "d AS (SELECT doc_id AS doc_index, n_chars // 200 AS page_count FROM documents)"
_SEGMENTS = f"""{_DOCS},
    g AS (SELECT doc_index, page_count, coalesce(sum(page_count) OVER (ORDER BY doc_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
    p AS (SELECT doc_index, unnest(range(page_count)) AS page_index, start FROM g),
    s AS (SELECT CAST((start + page_index) // 64 AS BIGINT) AS window_id, doc_index, min(page_index) AS page_start, count(*) AS take FROM p GROUP BY ALL)"""
_LINES = "l AS (SELECT doc_id AS line_id, lang, least((n_chars + 95) // 96 * 96, 2560) AS w FROM documents)"
_BATCHES = f"""{_LINES},
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY w, line_id) AS k FROM l),
    f AS (SELECT lang, k, line_id, w, CAST(0 AS BIGINT) AS batch_id, 1 AS size FROM r WHERE k = 1
          UNION ALL
          SELECT r.lang, r.k, r.line_id, r.w, CASE WHEN f.size < 6 AND (f.size + 1) * r.w <= 5120 THEN f.batch_id ELSE f.batch_id + 1 END,
                 CASE WHEN f.size < 6 AND (f.size + 1) * r.w <= 5120 THEN f.size + 1 ELSE 1 END
          FROM f JOIN r ON r.lang = f.lang AND r.k = f.k + 1)"""


# -- windows and batches -------------------------------------------------------------------------


@query(f"WITH {_SEGMENTS} SELECT * FROM s")
def plan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.plan_windows(_documents(spark, sf_dir))


@query(f"WITH {_SEGMENTS} SELECT CAST((start + page_index) // 64 AS BIGINT) AS window_id, doc_index, page_index FROM p")
def window_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pages_of(plan_windows(spark, sf_dir))


@query(f"WITH {_SEGMENTS} SELECT *, CAST(coalesce(sum(take) OVER (PARTITION BY window_id ORDER BY doc_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM s")
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.segment_offsets(plan_windows(spark, sf_dir))


@query(f"WITH {_SEGMENTS} SELECT doc_index, page_index, CAST((start + page_index) % 64 AS BIGINT) AS result FROM p")
def route_window_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result for each page of a window, in order, back to its document."""
    segments = segment_offsets(spark, sf_dir)
    ordinals = F.sequence("offset", F.col("offset") + F.col("take") - 1)
    results = segments.select("window_id", F.explode(ordinals).alias("ordinal")).withColumn("result", F.col("ordinal"))
    return routing.to_segments(results, segments).select("doc_index", "page_index", "result")


@query(f"WITH {_DOCS} SELECT * FROM d WHERE page_count = 0")
def zero_page_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.zero_page_documents(_documents(spark, sf_dir))


@query(f"WITH {_SEGMENTS} SELECT d.doc_index, CAST(coalesce(sum(take), 0) AS BIGINT) AS pages_done, max(window_id) AS final_window FROM d LEFT JOIN s USING (doc_index) GROUP BY d.doc_index")
def doc_completion_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.completion_windows(_documents(spark, sf_dir))


@query(f"WITH RECURSIVE {_BATCHES} SELECT lang, line_id, w, batch_id, max(w) OVER (PARTITION BY lang, batch_id) AS padded_w FROM f")
def adaptive_rec_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.adaptive_batches(_lines(spark, sf_dir).select("lang", "line_id", "w"))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 6 AS BIGINT) AS chunk_id FROM documents")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.fixed_chunks(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 6)


@query(f"""WITH RECURSIVE {_BATCHES}, b AS (SELECT line_id, w // 96 AS n, max(w // 96) OVER (PARTITION BY lang, batch_id) AS most FROM f)
    SELECT line_id, array_to_string([CASE WHEN i < n THEN i ELSE -1 END FOR i IN range(most)], ',') AS ids FROM b""")
def pad_to_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token lists of a batch padded to the longest of the batch."""
    batches = adaptive_rec_batches(spark, sf_dir)
    n, most = F.floor(F.col("w") / 96), F.floor(F.col("padded_w") / 96)
    ids = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    padded = scalar.pad_right(ids, most, F.lit(-1).cast("long"))
    return batches.select("line_id", F.array_join(padded.cast("array<string>"), ",").alias("ids"))


@query("SELECT o_orderkey, greatest(1, least(o_orderkey % 300, o_orderkey % 5 * 64)) AS size, least(8, o_orderkey % 5 * 64) AS det_size FROM orders")
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.col("o_orderkey") % 5
    return _table(spark, sf_dir, "orders").select("o_orderkey", scalar.batch_size(ratio, 64, F.col("o_orderkey") % 300).alias("size"), F.least(F.lit(8), ratio * 64).alias("det_size"))


# -- sizes and boxes -----------------------------------------------------------------------------


@query("""SELECT doc_id, CAST(least((n_chars + 95) // 96 * 96, 2560) AS BIGINT) AS quantized,
    CAST(least((greatest(least(CAST(trunc(48 * greatest(320.0::DOUBLE / 48, n_chars / 48.0::DOUBLE)) AS BIGINT), 2560), 16) + 95) // 96 * 96, 2560) AS BIGINT) AS effective,
    CAST(greatest(1, least(2560, greatest(CAST(ceil(48 * (n_chars / 48.0::DOUBLE)) AS BIGINT), 16))) AS BIGINT) AS resized,
    CAST(trunc(least(greatest(48 * greatest(n_chars / 48.0::DOUBLE, 0.1::DOUBLE), 16.0::DOUBLE), 2560.0::DOUBLE)) AS BIGINT) AS line FROM documents""")
def quantize_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("n_chars"), F.lit(48)
    made = {"quantized": scalar.quantize_width(w), "effective": scalar.effective_width(w, h), "resized": scalar.resized_width(w, h, F.lit(2560)), "line": scalar.line_width(w, h)}
    return _table(spark, sf_dir, "documents").select("doc_id", *(c.cast("long").alias(k) for k, c in made.items()))


def _det_sql(side: str) -> str:
    shrunk = f"CASE WHEN greatest(h, w) > 960 THEN trunc({side} * (960 / greatest(h, w)::DOUBLE)) ELSE {side} END"
    return f"CAST(greatest(round_even({shrunk} / 32.0::DOUBLE, 0) * 32, 32) AS BIGINT)"


@query(f"""WITH s AS (SELECT p_partkey, p_partkey % 2000 + 1 AS h, p_size * 31 + 8 AS w FROM part),
    t AS (SELECT *, {_det_sql('h')} AS det_h, {_det_sql('w')} AS det_w FROM s)
    SELECT p_partkey, det_h, det_w, det_h / h AS ratio_h, det_w / w AS ratio_w,
        CAST(least(greatest(round_even(h * least(736 / h, 960 / w, 1.0::DOUBLE) / 32, 0) * 32, 32), 736) AS BIGINT) AS fit_h FROM t""")
def det_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, w = (F.col("p_partkey") % 2000 + 1), (F.col("p_size") * 31 + 8)
    size = scalar.det_size(h, w)
    shape = scalar.shape_list(h, w, size)
    return _table(spark, sf_dir, "part").select("p_partkey", size["h"].cast("long").alias("det_h"), size["w"].cast("long").alias("det_w"), shape[2].alias("ratio_h"), shape[3].alias("ratio_w"), scalar.fit_profile(h, w)["h"].cast("long").alias("fit_h"))


@query("""SELECT CASE WHEN part_kind THEN 'dbnet' ELSE 'crnn' END AS engine, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM (
    SELECT l_partkey % 2 = 0 AS part_kind, (l_partkey % 800 BETWEEN 96 AND 736) AND (l_suppkey % 1000 BETWEEN 128 AND 960) AS hit FROM lineitem) GROUP BY part_kind""")
def engine_route_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = F.when(F.col("l_partkey") % 2 == 0, "dbnet").otherwise("crnn")
    hit = scalar.in_profile(F.col("l_partkey") % 800, F.col("l_suppkey") % 1000)
    return reports.hit_rates(_table(spark, sf_dir, "lineitem").select(engine.alias("engine"), hit.alias("hit")))


@query(f"""WITH i AS ({_ITEMS_SQL})
    SELECT page, item_idx, x1 - x0 + 100 AS new_width, y1 - y0 + 100 AS new_height, (x1 - x0) * (y1 - y0) AS area,
           CAST(trunc(x0 / (10.0::DOUBLE / 3)) AS BIGINT) AS scaled_x0 FROM i""")
def crop_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bbox")
    crop = scalar.padded_crop(b)
    return _items(spark, sf_dir).select("page", "item_idx", crop["new_width"].alias("new_width"), crop["new_height"].alias("new_height"), scalar.box_area(b).alias("area"), scalar.scale_box(b, 10 / 3)["x0"].cast("long").alias("scaled_x0"))


@query(f"""WITH i AS ({_ITEMS_SQL}) SELECT page, item_idx, CAST(x0 - 50 + x0 AS DOUBLE) AS px1, CAST(y0 - 50 + y0 AS DOUBLE) AS py1, CAST(x1 - 50 + x0 AS DOUBLE) AS px3, CAST(y1 - 50 + y0 AS DOUBLE) AS py3 FROM i""")
def translate_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bbox")
    moved = scalar.to_page(scalar.box_quad(b), scalar.padded_crop(b))
    return _items(spark, sf_dir).select("page", "item_idx", moved[0]["x"].alias("px1"), moved[0]["y"].alias("py1"), moved[2]["x"].alias("px3"), moved[2]["y"].alias("py3"))


def _slanted(b):
    """A quad whose right side is lower by a fifth of its width."""
    drop = scalar.box_width(b) / 5
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(b["x0"], b["y0"]), point(b["x1"], b["y0"] + drop), point(b["x1"], b["y1"] + drop), point(b["x0"], b["y1"]))


@query(f"""WITH i AS ({_ITEMS_SQL}), q AS (SELECT *, (x1 - x0) / 5 AS s FROM i)
    SELECT page, item_idx, (x0 + x1 + x1 + x0) / 4 - 1 * CAST(x1 - x0 AS DOUBLE) / 2 AS left_x,
           (y0 + (y0 + s) + (y1 + s) + y1) / 4 - 1 * (((y1 - y0) + ((y1 + s) - (y0 + s))) / 2) / 2 AS top_y,
           CAST(trunc(sqrt((x0 - x1) * (x0 - x1) + s * s)) AS BIGINT) AS crop_w, y1 - y0 AS crop_h, (y1 - y0) / (x1 - x0) >= 1.5::DOUBLE AS rotated
    FROM q""")
def derotate_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slanted quads made upright, and the size of their crops."""
    b = F.col("bbox")
    quad = _slanted(b)
    upright, size = scalar.derotate(quad), scalar.line_crop_size(quad)
    return _items(spark, sf_dir).select("page", "item_idx", upright[0]["x"].alias("left_x"), upright[0]["y"].alias("top_y"), size["w"].cast("long").alias("crop_w"), size["h"].cast("long").alias("crop_h"), scalar.needs_rotation(scalar.box_width(b), scalar.box_height(b)).alias("rotated"))


@query("""WITH s AS (SELECT p_partkey, p_size * 13 + 1 AS h, p_partkey % 900 + 1 AS w FROM part),
    r AS (SELECT *, least(384 / h, 384 / w) AS ratio FROM s),
    n AS (SELECT *, CAST(floor(h * ratio + 0.5::DOUBLE) AS BIGINT) AS new_h, CAST(floor(w * ratio + 0.5::DOUBLE) AS BIGINT) AS new_w FROM r)
    SELECT p_partkey, new_h, new_w, (384 - new_h) // 2 AS pad_top, (384 - new_w) // 2 AS pad_left FROM n""")
def letterbox_384(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = scalar.letterbox(F.col("p_size") * 13 + 1, F.col("p_partkey") % 900 + 1)
    return _table(spark, sf_dir, "part").select("p_partkey", *(fit[k].cast("long").alias(k) for k in ("new_h", "new_w", "pad_top", "pad_left")))


@query("""SELECT p_partkey, (p_partkey % 256) * 0.114::DOUBLE + (p_size % 256) * 0.587::DOUBLE + ((p_partkey * 7) % 256) * 0.299::DOUBLE AS luma FROM part""")
def grey_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select("p_partkey", scalar.luma(c % 256, F.col("p_size") % 256, (c * 7) % 256).alias("luma"))


# -- filters -------------------------------------------------------------------------------------


@query(f"WITH i AS ({_ITEMS_SQL}) SELECT page, item_idx, label, CASE WHEN part % 3 = 0 THEN '' ELSE 'x' || part END AS latex FROM i WHERE label IN ('display_formula', 'inline_formula')")
def formula_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    latex = F.when(F.col("part") % 3 != 0, F.concat(F.lit("x"), F.col("part")))
    return filters.formulas(_items(spark, sf_dir).withColumn("latex", latex)).select("page", "item_idx", "label", "latex")


@query(f"WITH i AS ({_ITEMS_SQL}) SELECT page, item_idx, label FROM i WHERE label IS DISTINCT FROM 'inline_formula'")
def formula_disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.without_inline_formulas(_items(spark, sf_dir)).select("page", "item_idx", "label")


@query(f"""WITH i AS ({_ITEMS_SQL}), t AS (SELECT * REPLACE ((500 + part % 500) / 1000 AS score), coalesce(({_NOISE_SQL})[part % 30 + 1], 'text') AS text FROM i)
    SELECT page, item_idx, text, CASE WHEN page % 2 = 0 THEN 1.0::DOUBLE ELSE CAST(printf('%.2f', score) AS DOUBLE) END AS score FROM t
    WHERE x1 - x0 >= 3 AND NOT (score < 0.65::DOUBLE OR (list_contains({_NOISE_SQL}, text) AND score < 0.8::DOUBLE AND x1 - x0 < y1 - y0))""")
def ocr_noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores have three places, so that half of those in an uneven last one look like ties."""
    rows = _items(spark, sf_dir).withColumns({"quad": scalar.box_quad(F.col("bbox")), "score": (500 + F.col("part") % 500) / 1000})
    rows = filters.without_noise(filters.wide_enough(filters.confident(rows, 0.65), "quad", 3), 0.65)
    return filters.as_ocr_text(rows, F.col("page") % 2 == 0).select("page", "item_idx", "text", "score")


@query(f"WITH i AS ({_ITEMS_SQL}) SELECT page, item_idx, CAST(printf('%.3f', score * 0.12345::DOUBLE) AS DOUBLE) AS score FROM i")
def score_three_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("page", "item_idx", filters.three_places(F.col("score") * 0.12345).alias("score"))


@query(f"""WITH i AS ({_ITEMS_SQL}) SELECT page, item_idx FROM i WHERE part % 5 <> 0 AND ((line % 3 = 0 AND score < 0.9::DOUBLE) OR line % 3 = 1)""")
def wired_table_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line") % 3
    label = F.when(line == 0, "WirelessTable").when(line == 1, "WiredTable").otherwise("Other")
    result = F.when(F.col("part") % 5 != 0, F.array("part"))
    rows = _items(spark, sf_dir).select("page", "item_idx", label.alias("cls_label"), F.col("score").alias("cls_score"), result.alias("ocr_result"))
    return filters.wired_tables(rows).select("page", "item_idx")


@query("""SELECT conv_id, turn, array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), '|') AS texts FROM conversations WHERE role = 'user'""")
def seal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "seal").otherwise("text").alias("label"), F.lit(1).alias("bbox"), F.split("text", " ").alias("seal_texts"))
    return filters.seals(rows).select("conv_id", "turn", F.array_join("seal_texts", "|").alias("texts"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false ELSE n_chars < 500 END AS ocr_enable FROM documents""")
def ocr_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(F.col("doc_id") % 3 == 0, "ocr").when(F.col("doc_id") % 3 == 1, "txt").otherwise("auto")
    return _table(spark, sf_dir, "documents").select("doc_id", filters.ocr_enabled(method, F.col("n_chars") < 500).alias("ocr_enable"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.0::DOUBLE ELSE value END AS score FROM events")
def finite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return _table(spark, sf_dir, "events").select("event_id", scalar.finite_score(F.col("event_type"), score)["score"].alias("score"))


# -- routing -------------------------------------------------------------------------------------


@query(f"""WITH i AS ({_ITEMS_SQL}), l AS (SELECT page, string_agg(item_idx || ':' || part, ',' ORDER BY item_idx) AS cells, count(*) AS n FROM i WHERE label = 'ocr_text' GROUP BY page)
    SELECT o_orderkey AS page, coalesce(n, 0) AS n_cells, coalesce(cells, '') AS cells FROM orders LEFT JOIN l ON o_orderkey = page""")
def table_ocr_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    lines = _items(spark, sf_dir).where("label = 'ocr_text'").withColumn("cell", F.concat_ws(":", "item_idx", "part"))
    joined = routing.appended(tables, lines, ["page"], "item_idx", ["cell"])
    return joined.select("page", F.size("ocr_result").cast("long").alias("n_cells"), F.array_join(F.transform("ocr_result", lambda c: c["cell"]), ",").alias("cells"))


@query(f"""WITH i AS ({_ITEMS_SQL}) SELECT page, item_idx, x0 + 3 AS x, y0 + 3 AS y FROM i AS p WHERE label IS NULL
    AND EXISTS (SELECT 1 FROM i AS b WHERE b.page = p.page AND b.label = 'ocr_text' AND b.x0 <= p.x0 + 3 AND p.x0 + 3 < b.x1 AND b.y0 <= p.y0 + 3 AND p.y0 + 3 < b.y1)""")
def mask_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    points = items.where("label is null").select("page", "item_idx", (F.col("bbox.x0") + 3).alias("x"), (F.col("bbox.y0") + 3).alias("y"))
    return routing.masked_points(points, items.where("label = 'ocr_text'"), "page")


@query(f"""WITH i AS ({_ITEMS_SQL}), k AS (SELECT *, (page // 50) AS sheet FROM i)
    SELECT r.page, r.item_idx, b.page AS box_page, b.item_idx AS box_idx FROM k r JOIN k b ON r.sheet = b.sheet
    WHERE r.label = 'ocr_text' AND b.label = 'inline_formula' AND greatest(r.x0, b.x0) < least(r.x1, b.x1) AND greatest(r.y0, b.y0) < least(r.y1, b.y1)""")
def region_formula_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).withColumn("sheet", F.floor(F.col("page") / 50))
    side = lambda label: rows.where(F.col("label") == label).select("sheet", "page", "item_idx", "bbox")
    pairs = routing.overlapping(side("ocr_text"), side("inline_formula"), "sheet")
    return pairs.select("region.page", "region.item_idx", F.col("box.page").alias("box_page"), F.col("box.item_idx").alias("box_idx"))


@query(f"WITH i AS ({_ITEMS_SQL}) SELECT page, item_idx, row_number() OVER (PARTITION BY page ORDER BY (x1 - x0) * (y1 - y0), item_idx) - 1 AS rank FROM i")
def sort_unsort(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = routing.sorted_ranks(_items(spark, sf_dir), scalar.box_area(F.col("bbox")), "item_idx", ["page"])
    return ranked.select("page", "item_idx", F.col("rank").cast("long").alias("rank"))


@query(f"WITH i AS ({_ITEMS_SQL}) SELECT page, item_idx FROM i WHERE score >= 0.8::DOUBLE OR label IS NULL")
def remove_listed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    removed = items.where("score < 0.8 and label is not null")
    return routing.minus(items, removed, ["page", "item_idx"]).select("page", "item_idx")


@query("""SELECT DISTINCT lang, CASE lang WHEN 'en' THEN 'latin' WHEN 'de' THEN 'german' ELSE 'default' END AS model FROM documents""")
def lang_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("en", "latin"), ("de", "german"), ("zh", "chinese")], "lang string, model string")
    return routing.language_models(_table(spark, sf_dir, "documents"), known, "default")


# -- texts ---------------------------------------------------------------------------------------


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


_TABLE_SQL = "CASE page_id % 4 WHEN 0 THEN 'a<table>' || url || '</table>b' WHEN 1 THEN '<table>1</table>' || url || '<table>2</table>x' WHEN 2 THEN '</table>' || url || '<table>' ELSE NULL END"


@query(f"""WITH t AS (SELECT page_id, coalesce({_TABLE_SQL}, '') AS h FROM pages)
    SELECT page_id, CASE WHEN contains(h, '<table>') AND contains(h, '</table>') THEN regexp_extract(h, '(?s)<table>.*</table>', 0) ELSE h END AS html FROM t""")
def table_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", text.table_trim(F.expr(_TABLE_SQL)).alias("html"))


@query("""SELECT p_partkey, CASE WHEN len(p_name) <= 8 THEN p_name ELSE left(p_name, 4) || '…' || right(p_name, 3) END AS name FROM part""")
def display_ellipsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", text.middle_ellipsis(F.col("p_name"), 8).alias("name"))


@query("""SELECT page_id, 'page-' || page_id || '.v2' AS name, 'mfr:' || page_id || 'x144x2048,det:' || page_id || 'x144x2048' AS shapes,
    CASE WHEN page_id % 2 = 0 THEN 'True' ELSE 'False' END AS flag FROM pages""")
def names_and_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.array(F.col("page_id"), F.lit(144).cast("long"), F.lit(2048).cast("long"))
    rows = _table(spark, sf_dir, "pages")
    return rows.select("page_id", text.stem(F.concat("url", F.lit("/page-"), "page_id", F.lit(".v2.pdf"))).alias("name"), text.shape_string(F.array(F.lit("mfr"), F.lit("det")), shape).alias("shapes"), text.flag_text(F.col("page_id") % 2 == 0).alias("flag"))


@query("""SELECT event_id, [event_type, 'k' || CAST(json_extract(props, '$.k') AS VARCHAR)] AS equations FROM events""")
def recursive_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.concat(F.lit('{"z":[{"type":"inline_equation","content":"'), F.col("event_type"), F.lit('"}],"a":{"type":"interline_equation","latex":"k'), F.get_json_object("props", "$.k"), F.lit('"}}'))
    return _table(spark, sf_dir, "events").select("event_id", text.equations(node).alias("equations"))


# -- comparisons ---------------------------------------------------------------------------------


#: Lines as programs read them: many characters end one, and none begins behind the last end.
_LINES_OF = r"CASE WHEN {0} = '' THEN [] ELSE string_split(regexp_replace(regexp_replace({0}, '\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '\n\z', ''), chr(10)) END"
_ENDING = "CASE doc_id % 7 WHEN 0 THEN text || chr(10) WHEN 1 THEN text || chr(13) || chr(10) || 'a' || chr(8232) WHEN 2 THEN chr(11) || text || chr(10) || chr(10) ELSE text END"
_VARIANT = "replace(text, CASE WHEN doc_id % 3 = 0 THEN 'the ' WHEN doc_id % 3 = 1 THEN chr(10) ELSE 'zz-zz' END, CASE WHEN doc_id % 3 = 1 THEN ' ' ELSE 'THE ' END)"


@query(f"""WITH v AS (SELECT doc_id, {_ENDING} AS a, {_VARIANT} AS b FROM documents), s AS (SELECT *, {_LINES_OF.format('a')} AS x, {_LINES_OF.format('b')} AS y FROM v)
    SELECT doc_id, CASE WHEN a = b THEN 'identical' ELSE 'differ' END AS verdict,
    CASE WHEN a = b THEN 0 ELSE CAST(coalesce(list_sum([CASE WHEN x[i] = y[i] THEN 0 ELSE 1 END FOR i IN range(1, least(len(x), len(y)) + 1)]), 0) + abs(len(x) - len(y)) AS BIGINT) END AS lines FROM s""")
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = _ENDING.replace("chr(8232)", "'\u2028'")  # Spark's chr has only 256 characters
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.expr(ending).alias("a"), F.expr(_VARIANT).alias("b"))
    found = compare.verdict(F.col("a"), F.col("b"))
    return rows.select("doc_id", found["verdict"].alias("verdict"), found["lines"].cast("long").alias("lines"))


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("position"), F.col("event_type").alias("value")), rows.where("event_type <> 'error'").select(F.col("event_id").alias("position"), F.when(F.col("event_id") % 5 == 0, "other").otherwise(F.col("event_type")).alias("value"))


@query("SELECT count(*) AS compared, count(*) FILTER (event_id % 5 <> 0) AS equal FROM events WHERE event_type <> 'error'")
def pair_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.equal_pairs(*_pair(spark, sf_dir))


@query("SELECT event_id AS position, event_type AS a, 'other' AS b FROM events WHERE event_type <> 'error' AND event_id % 5 = 0 ORDER BY event_id LIMIT 20")
def first_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty, as the report shows."""
    return compare.first_differences(*_pair(spark, sf_dir))


@query("""WITH e AS (SELECT CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 10000) AS DOUBLE) AS a FROM embeddings), g AS (SELECT abs(a - floor(a / 7) * 7) AS gap FROM e)
    SELECT max(gap) AS max_gap, avg(gap) AS mean_gap, max(gap) < 0.001 AS accepted FROM g""")
def numeric_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _table(spark, sf_dir, "embeddings").select(F.explode("embedding").alias("e")).select(F.floor(F.col("e").cast("double") * 10000).cast("double").alias("a"))
    return compare.alignment(values.withColumn("b", F.floor(F.col("a") / 7).cast("double") * 7))


# -- reports -------------------------------------------------------------------------------------


_TIMINGS = "t AS (SELECT event_type AS stage, CAST(floor(value * 100) AS DOUBLE) AS wall_ms FROM events)"


def _timings(spark: SparkSession, sf_dir: str, name: str, value: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias(name), F.floor(F.col("value") * 100).cast("double").alias(value))


@query(f"""WITH {_TIMINGS}, s AS (SELECT stage, count(*) AS calls, sum(wall_ms) AS wall_ms FROM t GROUP BY stage), k AS (SELECT sum(wall_ms) + 1000 AS total FROM s),
    a AS (SELECT * FROM s UNION ALL SELECT 'other', 1, 1000.0::DOUBLE)
    SELECT stage, calls, wall_ms, wall_ms / total * 100 AS pct FROM a, k""")
def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    timings = _timings(spark, sf_dir, "stage", "wall_ms")
    return reports.stage_report(timings, timings.agg((F.sum("wall_ms") + 1000).alias("total_ms")))


@query(f"""WITH {_TIMINGS}, m AS (SELECT CASE stage WHEN 'click' THEN '1_layout' WHEN 'view' THEN '4_ocr_det' WHEN 'purchase' THEN '3_table' END AS stage, wall_ms FROM t)
    SELECT stage, count(*) AS calls, sum(wall_ms) AS wall_ms, sum(wall_ms) / sum(sum(wall_ms)) OVER () * 100 AS pct FROM m WHERE stage IS NOT NULL GROUP BY stage""")
def mapped_stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("kind") == "click", "layout").when(F.col("kind") == "view", "ocr_det").when(F.col("kind") == "purchase", "wired_table").otherwise(F.col("kind"))
    return reports.stage_report(reports.mapped_stages(_timings(spark, sf_dir, "kind", "wall_ms").withColumn("kind", kind)))


@query(f"""WITH {_TIMINGS}, s AS (SELECT stage, count(*) AS calls, CAST(sum(wall_ms) AS BIGINT) AS ms FROM t GROUP BY stage)
    SELECT doc_id, CASE WHEN doc_id = (SELECT min(doc_id) FROM documents) THEN (SELECT string_agg(stage || ':' || calls || ':' || ms, ',' ORDER BY stage) FROM s) END AS batch_table FROM documents""")
def first_batch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first result carries the run's table."""
    table = reports.stage_report(_timings(spark, sf_dir, "stage", "wall_ms"))
    rows = reports.with_batch_table(_table(spark, sf_dir, "documents").select("doc_id"), table, "doc_id")
    cell = F.transform("batch_table", lambda r: F.concat_ws(":", r["stage"], r["calls"], r["wall_ms"].cast("long")))
    return rows.select("doc_id", F.when(F.col("batch_table").isNotNull(), F.array_join(cell, ",")).alias("batch_table"))


@query(f"WITH {_TIMINGS} SELECT stage AS section, count(*) AS calls, sum(wall_ms) AS ms, sum(wall_ms) / sum(sum(wall_ms)) OVER () * 100 AS pct FROM t GROUP BY stage")
def section_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.section_report(_timings(spark, sf_dir, "section", "ms"))


@query("""WITH r AS (SELECT n_chars // 200 AS pages, CAST(n_chars * 3 AS DOUBLE) AS ms FROM documents), s AS (SELECT count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages, max(ms) AS total_ms FROM r)
    SELECT *, total_ms / documents / 1000 AS seconds_a_document, pages / (total_ms / 1000) AS pages_a_second FROM s""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_summary(_table(spark, sf_dir, "documents").select(F.expr("n_chars div 200").alias("pages"), (F.col("n_chars") * 3).cast("double").alias("process_ms")))


@query(f"""WITH {_TIMINGS}, s AS (SELECT min(wall_ms) FILTER (stage = 'view') AS base_min, avg(wall_ms) FILTER (stage = 'view') AS base_avg, min(wall_ms) FILTER (stage = 'click') AS fast_min, avg(wall_ms) FILTER (stage = 'click') AS fast_avg FROM t)
    SELECT *, CASE WHEN fast_min <> 0 THEN base_min / fast_min END AS speed_up, (base_min - fast_min) / 1000 AS saved_s FROM s""")
def ab_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.speed_up(_timings(spark, sf_dir, "mode", "ms"), "view", "click")


@query("""SELECT p_partkey, array_to_string(list_concat(range(p_size % 4), range(p_partkey % 5)), ',') AS flat, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 5 - 1 WHEN p_size % 4 > 0 THEN p_size % 4 - 1 END AS last FROM part""")
def flattened_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    made = scalar.last_flattened(F.array(ids((F.col("p_size") % 4).cast("long")), ids((F.col("p_partkey") % 5).cast("long"))))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(made["flat"].cast("array<string>"), ",").alias("flat"), made["last"].alias("last"))


@query("""SELECT event_type AS engine, count(DISTINCT user_id) AS injected FROM events GROUP BY event_type""")
def injected_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.injected(_table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.col("user_id").alias("part_id")))


@query("SELECT bool_and(o_totalprice > 0) AS passed FROM orders")
def builds_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.all_passed(_table(spark, sf_dir, "orders").select((F.col("o_totalprice") > 0).alias("passed")))


@query("""SELECT sum(CAST(floor(value) AS DOUBLE)) AS seconds, count(*) * 3 AS formulas, sum(CAST(floor(value) AS DOUBLE)) / (count(*) * 3) * 1000000.0::DOUBLE AS us_a_formula FROM events""")
def formula_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.formula_cost(_table(spark, sf_dir, "events").select(F.floor("value").cast("double").alias("seconds"), F.lit(3).alias("formulas")))


# -- models --------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT p_partkey, CAST(p_size % 12 AS BIGINT) AS n FROM part)
    SELECT p_partkey AS formula_id, CASE WHEN n <= 1 THEN '0 1' ELSE '0 ' || array_to_string([n - i FOR i IN range(n)], ' ') END AS latex FROM n""")
def greedy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formula recognition with the counting stand-in for the net."""
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("formula_id"), F.col("p_size").alias("area"), F.array((F.col("p_size") % 12).cast("double")).alias("hidden"))
    return models.recognise_formulas(rows).select("formula_id", "latex")


def _line_model():
    def read(rows: pd.DataFrame) -> pd.DataFrame:
        w, widest, ids = (rows[c].to_numpy() for c in ("w", "padded_w", "line_id"))
        return pd.DataFrame({"text": [f"w{x}" for x in w.tolist()], "score": np.where((ids % 9 == 0) | (widest == 0), np.nan, w / max(widest.max(), 1))})

    return read


@query(f"""WITH RECURSIVE {_BATCHES} SELECT line_id, 'w' || w AS text, CASE WHEN line_id % 9 = 0 THEN 0.0::DOUBLE ELSE w / max(w) OVER (PARTITION BY lang, batch_id) END AS score FROM f""")
def recognise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line recognition, a call per batch under the budget, with a stand-in for the net."""
    made = models.recognise_lines(adaptive_rec_batches(spark, sf_dir), _line_model)
    # in a batch without width SQL's 0 / 0 is no number, which the stage can't tell from the model's own
    none = (F.col("padded_w") == 0) & (F.col("line_id") % 9 != 0)
    return made.select("line_id", "text", F.when(none, F.lit(float("nan"))).otherwise(F.col("score")).alias("score"))
