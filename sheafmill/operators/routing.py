"""Join-shaped work: results back to their inputs, segments, tables and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar


def zipped(left: Column, right: Column, names: tuple[str, str] = ("left", "right")) -> Column:
    """Pairs of two arrays' elements; arrays of different sizes fail the query."""
    same = F.assert_true(F.size(left) == F.size(right), F.lit("the lists differ in length"))
    pairs = F.zip_with(left, right, lambda a, b: F.struct(a.alias(names[0]), b.alias(names[1])))
    return F.when(same.isNull(), pairs)


def by_ordinal(inputs: DataFrame, results: DataFrame, key: Sequence[str]) -> DataFrame:
    """Results joined to their inputs by group and ordinal."""
    return inputs.join(results, list(key), "left")


def to_segments(results: DataFrame, segments: DataFrame) -> DataFrame:
    """Flat results of windows (window_id, ordinal, ...) with doc_index and page_index; `segments` has
    offsets. A window has few segments, so the range condition is checked within equal windows."""
    inside = (F.col("ordinal") >= F.col("offset")) & (F.col("ordinal") < F.col("offset") + F.col("take"))
    routed = results.join(segments, "window_id").where(inside)
    return routed.select("doc_index", (F.col("page_start") + F.col("ordinal") - F.col("offset")).alias("page_index"), *(c for c in results.columns if c != "ordinal"))


def sorted_ranks(rows: DataFrame, value: Column, key: str, group: Sequence[str]) -> DataFrame:
    """`rows` with rank, their place by value and key within a group that one batch can hold."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(value, key)) - 1)


def appended(tables: DataFrame, lines: DataFrame, key: Sequence[str], order: str, columns: Sequence[str], name: str = "ocr_result") -> DataFrame:
    """Tables with the array of their lines in order; an empty one without lines. Lines are gathered by
    table, which bounds an array by what one page holds."""
    lists = lines.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("__lines"))
    joined = tables.join(lists, list(key), "left")
    found = F.transform("__lines", lambda line: F.struct(*(line[c].alias(c) for c in columns)))
    return joined.withColumn(name, F.coalesce(found, F.array().cast(joined.select(found.alias("x")).schema["x"].dataType))).drop("__lines")


def with_default(rows: DataFrame, lookup: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """`rows` with an array column of the lookup, empty where it has no entry."""
    joined = rows.join(lookup, list(key), "left")
    return joined.withColumn(column, F.coalesce(column, F.array().cast(lookup.schema[column].dataType)))


def merged_cells(cells: Column, objects: Column, by: str = "order") -> Column:
    """Recognised cells and inline objects, both arrays of one struct, in order of the field."""
    return F.array_sort(F.concat(cells, objects), lambda a, b: F.when(a[by] < b[by], -1).when(a[by] > b[by], 1).otherwise(0))


def masked_points(points: DataFrame, boxes: DataFrame, page: str, cell: int = 64) -> DataFrame:
    """Points (x, y) that lie in any half-open box (bbox) of their page, each once. Boxes are entered in
    every grid cell that they touch, so that the join is by page and cell, not by page alone."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell))
    solid = boxes.where("bbox.x1 > bbox.x0 and bbox.y1 > bbox.y0")
    entered = solid.select(page, "bbox", F.explode(span("bbox.x0", "bbox.x1")).alias("__cx"), F.lit(0).alias("__y"))
    entered = entered.select(page, "bbox", "__cx", F.explode(span("bbox.y0", "bbox.y1")).alias("__cy"))
    placed = points.withColumns({"__cx": F.floor(F.col("x") / cell), "__cy": F.floor(F.col("y") / cell)})
    p, b = placed.alias("p"), entered.alias("b")
    equal = [F.col(f"p.{c}") == F.col(f"b.{c}") for c in (page, "__cx", "__cy")]
    inside = scalar.contains_pixel(F.col("b.bbox"), F.col("p.x"), F.col("p.y"))
    return p.join(b, [*equal, inside], "left_semi").select(points.columns)


def overlapping(regions: DataFrame, boxes: DataFrame, page: str, cell: int = 256) -> DataFrame:
    """Pairs of a region and a box of one page that overlap, region and box both `bbox`. Both sides are
    entered in the grid cells that they touch; a pair is given in the first cell that they share."""
    def entered(rows: DataFrame, name: str) -> DataFrame:
        b = F.col("bbox")
        span = lambda lo, hi: F.sequence(F.floor(b[lo] / cell), F.floor((b[hi] - 1) / cell))
        rows = rows.where("bbox.x1 > bbox.x0 and bbox.y1 > bbox.y0")
        rows = rows.select(page, F.struct(*(c for c in rows.columns if c != page)).alias(name), "bbox", F.explode(span("x0", "x1")).alias("cx"))
        return rows.select(page, name, "cx", F.explode(F.sequence(F.floor(F.col("bbox.y0") / cell), F.floor((F.col("bbox.y1") - 1) / cell))).alias("cy"))

    pairs = entered(regions, "region").join(entered(boxes, "box"), [page, "cx", "cy"])
    r, b = F.col("region.bbox"), F.col("box.bbox")
    x, y = F.greatest(r["x0"], b["x0"]), F.greatest(r["y0"], b["y0"])
    meet = (x < F.least(r["x1"], b["x1"])) & (y < F.least(r["y1"], b["y1"]))
    first = (F.floor(x / cell) == F.col("cx")) & (F.floor(y / cell) == F.col("cy"))
    return pairs.where(meet & first).select(page, "region", "box")


def minus(items: DataFrame, removed: DataFrame, key: Sequence[str]) -> DataFrame:
    return items.join(removed.select(*key).distinct(), list(key), "left_anti")


def language_models(lines: DataFrame, models: DataFrame, default: str) -> DataFrame:
    """Each language that occurs, with its model, or the default where there is none."""
    return lines.select("lang").distinct().join(models, "lang", "left").withColumn("model", F.coalesce("model", F.lit(default)))
