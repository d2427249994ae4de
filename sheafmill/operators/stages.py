"""Stages of a window as one plan: formulas, text lines, tables, seals. Nets are functions of DataFrames.

Items have doc_index, page_index, item_idx, label, bbox, score, text, latex and html; `KEY` identifies
one. Pages have doc_index, page_index, lang, ocr_enable, width and height.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar, text
from . import filters, models, routing, windows

KEY = ("doc_index", "page_index", "item_idx")
PAGE = KEY[:2]
TEXT_LABELS = ("text", "title", "caption", "footnote")

#: Takes rows and gives back KEY columns with what it found.
Net = Callable[[DataFrame], DataFrame]


def formula_stage(items: DataFrame, decode: Net, enabled: bool = True) -> DataFrame:
    """All items, formulas with the latex that `decode` (KEY, latex) gives them; with formulas off,
    inline ones go."""
    if not enabled:
        return filters.without_inline_formulas(items)
    found = decode(filters.formulas(items)).select(*KEY, F.col("latex").alias("__latex"))
    is_formula = F.col("label").isin(*filters.FORMULAS)
    joined = items.join(found, list(KEY), "left")
    latex = F.when(is_formula, F.coalesce("__latex", "latex", F.lit(""))).otherwise(F.col("latex"))
    return joined.select(*(latex.alias(c) if c == "latex" else F.col(c) for c in items.columns))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """`rows` with a column that later filters refer to: it passes a generator, so that the optimizer
    doesn't repeat its expression in each of them, which for nested geometry grows without end."""
    return rows.select(*(c for c in rows.columns if c != name), F.explode(F.array(value)).alias(name))


def is_slanted(quad: Column, slope: float = 0.1) -> Column:
    """A stand-in for the detector's own test: the upper side rises or falls by a tenth of its width."""
    width = quad[1]["x"] - quad[0]["x"]
    return F.abs(quad[1]["y"] - quad[0]["y"]) > slope * width


def text_stage(items: DataFrame, pages: DataFrame, detect: Net, loader: models.Loader, least: float = 0.5, width: float = 3.0, crop: Net | None = None, key: tuple = ("ocr_rec",), most: int = windows.ITEMS, budget: int = windows.BUDGET) -> DataFrame:
    """Recognised lines (PAGE, line_id, bbox, text, score) of the text regions: `detect` gives line_id,
    which is unique (a number, or a struct that begins with PAGE), and quad of each line of a region's padded crop; lines are moved to their page,
    set upright, cut to it and recognised in batches under the budget, by language; noise goes. `crop`
    gives the image of each line (line_id and what a reader takes)."""
    crops = items.where(F.col("label").isin(*TEXT_LABELS) & F.col("bbox").isNotNull())
    crops = crops.select(*KEY, scalar.padded_crop(F.col("bbox")).alias("crop"))
    lines = detect(crops).select(*KEY, "line_id", "quad").join(crops, list(KEY)).join(pages, list(PAGE))
    lines = filters.wide_enough(lines, "quad", width)
    lines = _once(lines, "quad", scalar.to_page(F.col("quad"), F.col("crop")))
    quad = F.col("quad")
    lines = _once(lines, "quad", F.when(is_slanted(quad), scalar.derotate(quad)).otherwise(quad))
    corner = lambda f, k: f(F.transform("quad", lambda p: p[k]))
    bounds = scalar.box(corner(F.array_min, "x"), corner(F.array_min, "y"), corner(F.array_max, "x"), corner(F.array_max, "y"))
    lines = _once(lines, "bounds", bounds)
    lines = filters.boxed(_once(lines, "bbox", scalar.clamp_box(F.col("bounds"), F.col("width"), F.col("height"))))
    lines = _once(lines, "size", scalar.line_crop_size(quad)).where(filters.croppable(F.col("size.w"), F.col("size.h")))
    turned = scalar.needs_rotation(F.col("size.w"), F.col("size.h"))
    w, h = F.when(turned, F.col("size.h")).otherwise(F.col("size.w")), F.when(turned, F.col("size.w")).otherwise(F.col("size.h"))
    lines = lines.withColumn("w", scalar.quantize_width(scalar.line_width(w, h)))
    plain = not isinstance(lines.schema["line_id"].dataType, T.StructType)
    place = None if plain else (F.col("line_id.doc_index") * (1 << 20) + F.col("line_id.page_index")).cast("double")
    batches = windows.adaptive_batches(lines.select("line_id", "lang", "w"), items=most, budget=budget, place=place)
    batches = batches if crop is None else batches.join(crop(lines), "line_id")
    read = models.recognise_lines(batches, loader, key).select("line_id", "text", filters.three_places(F.col("score")).alias("score"))
    known = lines.select(*PAGE, "line_id", "bbox", "ocr_enable").join(read, "line_id")
    kept = filters.as_ocr_text(filters.without_noise(known, least), F.col("ocr_enable"))
    return kept.select(*PAGE, "line_id", "label", "bbox", "text", "score")


def table_stage(tables: DataFrame, cells: DataFrame, wireless: Net, wired: Net, inline: DataFrame | None = None) -> DataFrame:
    """Tables (KEY, cls_label, cls_score) with html. `cells` (KEY, order, text) are recognised, `inline`
    ones (the same columns) other objects in them; wireless gives html for all, wired for those that
    are routed to it; html is cut to its table."""
    escaped = cells.withColumn("text", text.escaped_cell(F.col("text")))
    whole = escaped if inline is None else escaped.unionByName(inline)
    filled = routing.appended(tables, whole, KEY, "order", ["text"])
    first = wireless(filled).select(*KEY, F.col("html").alias("first"))
    second = wired(filters.wired_tables(filled)).select(*KEY, F.col("html").alias("second"))
    joined = tables.drop("html").join(first, list(KEY), "left").join(second, list(KEY), "left")
    return joined.select(*KEY, text.table_trim(F.coalesce("second", "first")).alias("html"))


def seal_stage(items: DataFrame, recognise: Net) -> DataFrame:
    """Seals (KEY, bbox) with the non-empty texts that `recognise` (KEY, seal_texts) finds."""
    boxes = items.where((F.col("label") == "seal") & F.col("bbox").isNotNull())
    boxes = boxes.where(filters.croppable(scalar.box_width(F.col("bbox")), scalar.box_height(F.col("bbox"))))
    return filters.seals(boxes.join(recognise(boxes).select(*KEY, "seal_texts"), list(KEY), "left")).select(*KEY, "bbox", "seal_texts")


def down_and_right(bbox: Column) -> Column:
    """A place in reading order: top to bottom and left to right."""
    return F.struct(bbox["y0"], bbox["x0"])


def page_blocks(items: DataFrame, lines: DataFrame, tables: DataFrame, seals: DataFrame, order: Callable[[Column], Column] = down_and_right) -> DataFrame:
    """PAGE and blocks: all results of a page in the order of their boxes' places; those without a box first."""
    block = lambda label, bbox, body: F.struct(order(bbox).alias("at"), label.alias("label"), bbox.alias("bbox"), body.cast("string").alias("content"))
    rows = items.where(F.col("label").isin(*filters.FORMULAS)).select(*PAGE, block(F.col("label"), F.col("bbox"), F.col("latex")).alias("b"))
    rows = rows.unionByName(lines.select(*PAGE, block(F.col("label"), F.col("bbox"), F.col("text")).alias("b")))
    placed = tables.join(items.select(*KEY, "bbox"), list(KEY))
    rows = rows.unionByName(placed.select(*PAGE, block(F.lit("table"), F.col("bbox"), F.col("html")).alias("b")))
    rows = rows.unionByName(seals.select(*PAGE, block(F.lit("seal"), F.col("bbox"), F.array_join("seal_texts", "\n")).alias("b")))
    gathered = rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list("b")).alias("b"))
    return gathered.select(*PAGE, F.transform("b", lambda b: F.struct(b["label"].alias("label"), b["bbox"].alias("bbox"), b["content"].alias("content"))).alias("blocks"))
