"""Pixel kernels over synthetic images, and the same pixel by pixel in SQL.

The test tables hold no images: a row of `supplier` (of `nation` for the largest kernel) is one, whose
sizes and bytes follow from its key. Factors are chosen so that numbers of single precision are exact
where they are resampled. A result is told by a sum of its values, weighted by their places.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..operators import rasters
from .queries import _table, query


def _images(spark: SparkSession, sf_dir: str, h: str, w: str, table: str = "supplier", key: str = "s_suppkey") -> DataFrame:
    rows = _table(spark, sf_dir, table).select(F.col(key).cast("long").alias("k"))
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, "k")  # a row of few bytes is much work
    rows = rows.select("k", F.expr(h).cast("int").alias("h"), F.expr(w).cast("int").alias("w"))
    value = lambda i: (F.col("k") * 7 + F.floor(i / (F.col("w") * 3)) * 31 + F.floor(i / 3) % F.col("w") * 17 + i % 3 * 59) % 256
    data = F.array_join(F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") * 3 - 1), lambda i: F.lpad(F.hex(value(i).cast("long")), 2, "0")), "")
    return rows.withColumn("data", F.unhex(data))


def _pixels(h: str, w: str, table: str = "supplier", key: str = "s_suppkey") -> str:
    """Tables s (k, h, w) and p (k, y, x, c, v)."""
    return f"""s AS (SELECT k, CAST({h} AS BIGINT) AS h, CAST({w} AS BIGINT) AS w FROM (SELECT CAST({key} AS BIGINT) AS k FROM {table})),
        q AS (SELECT *, unnest(range(h * w * 3)) AS i FROM s),
        p AS (SELECT k, h, w, i // (w * 3) AS y, i // 3 % w AS x, i % 3 AS c, (k * 7 + i // (w * 3) * 31 + i // 3 % w * 17 + i % 3 * 59) % 256 AS v FROM q)"""


_WEIGHT = "(1 + y * 7 + x * 13 + c * 101)"


def _digest() -> Column:
    @F.pandas_udf(T.LongType())
    def sums(h: pd.Series, w: pd.Series, data: pd.Series) -> pd.Series:
        def one(h: int, w: int, data: bytes) -> int:
            y, x, c = np.indices((h, w, 3))
            return int((np.frombuffer(data, np.uint8).reshape(h, w, 3).astype(np.int64) * (1 + y * 7 + x * 13 + c * 101)).sum())

        return pd.Series([one(*row) for row in zip(h, w, data)])

    return sums("h", "w", "data")


def _told(images: DataFrame, *key: str) -> DataFrame:
    return images.select(*key, F.col("h").cast("long").alias("h"), F.col("w").cast("long").alias("w"), _digest().alias("digest"))


def _tensor_told(rows: DataFrame) -> DataFrame:
    @F.pandas_udf(T.DoubleType())
    def sums(shape: pd.Series, tensor: pd.Series) -> pd.Series:
        def one(shape: np.ndarray, values: np.ndarray) -> float:
            c, y, x = np.indices(tuple(shape))
            return float((values.reshape(tuple(shape)).astype(float) * (1 + y * 7 + x * 13 + c * 101)).mean())

        return pd.Series([one(*row) for row in zip(shape, tensor)])

    return rows.select("k", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), F.round(sums("shape", "tensor"), 2).alias("digest"))


_SMALL = ("4 + k % 5", "6 + k % 7")


def _sampled(out_h: str, out_w: str, sy: str, sx: str) -> str:
    """r (k, y, x, c, v): samples between four pixels of p at the places sy and sx, edges repeated."""
    return f"""o AS (SELECT k, h, w, {out_h} AS oh, {out_w} AS ow, unnest(range({out_h} * {out_w} * 3)) AS i FROM s),
        g AS (SELECT *, i // (ow * 3) AS y, i // 3 % ow AS x, i % 3 AS c FROM o),
        f AS (SELECT *, greatest(0, least(h - 1, {sy})) AS fy, greatest(0, least(w - 1, {sx})) AS fx FROM g),
        t AS (SELECT *, CAST(floor(fy) AS BIGINT) AS y0, CAST(floor(fx) AS BIGINT) AS x0 FROM f),
        r AS (SELECT t.k, t.oh, t.ow, t.y, t.x, t.c,
                (a.v + (b.v - a.v) * (fx - x0)) + ((d.v + (e.v - d.v) * (fx - x0)) - (a.v + (b.v - a.v) * (fx - x0))) * (fy - y0) AS v
              FROM t JOIN p a ON a.k = t.k AND a.c = t.c AND a.y = y0 AND a.x = x0 JOIN p b ON b.k = t.k AND b.c = t.c AND b.y = y0 AND b.x = least(x0 + 1, t.w - 1)
                JOIN p d ON d.k = t.k AND d.c = t.c AND d.y = least(y0 + 1, t.h - 1) AND d.x = x0 JOIN p e ON e.k = t.k AND e.c = t.c AND e.y = least(y0 + 1, t.h - 1) AND e.x = least(x0 + 1, t.w - 1))"""


@query(f"""WITH {_pixels(*_SMALL)}, {_sampled('2 * h', '2 * w', '(y + 0.5::DOUBLE) / 2 - 0.5::DOUBLE', '(x + 0.5::DOUBLE) / 2 - 0.5::DOUBLE')},
    n AS (SELECT *, CAST((CAST(v AS FLOAT) / 255::FLOAT - [0.485, 0.456, 0.406][c + 1]::FLOAT) / [0.229, 0.224, 0.225][c + 1]::FLOAT AS DOUBLE) AS z FROM r)
    SELECT k, '3x' || max(oh) || 'x' || max(ow) AS shape, round(avg(z * {_WEIGHT}), 2) AS digest FROM n GROUP BY k""")
def detector_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tensor_told(rasters.det_inputs(_images(spark, sf_dir, *_SMALL), F.col("h") * 2, F.col("w") * 2))


_CROP = "k % 4 - 2 AS x0, k % 3 - 1 AS y0, k % 4 + 3 AS x1, k % 3 + 3 AS y1"


def _boxes(images: DataFrame, *boxes: str) -> DataFrame:
    parts = [images.select("k", F.lit(n).cast("long").alias("box_id"), F.expr(f"CAST(named_struct({b}) AS struct<x0:int,y0:int,x1:int,y1:int>)").alias("bbox")) for n, b in enumerate(boxes)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows


@query(f"""WITH {_pixels(*_SMALL)}, b AS (SELECT *, {_CROP} FROM s), o AS (SELECT *, unnest(range(8 * 9 * 3)) AS i FROM b),
    g AS (SELECT *, i // 27 AS y, i // 3 % 9 AS x, i % 3 AS c FROM o),
    r AS (SELECT g.k, g.y, g.x, g.c, coalesce(p.v, 255) AS v FROM g LEFT JOIN p ON p.k = g.k AND p.c = 2 - g.c AND p.y = g.y - 2 + y0 AND p.x = g.x - 2 + x0
          AND g.y >= 2 AND g.y < 6 AND g.x >= 2 AND g.x < 7)
    SELECT k, CAST(0 AS BIGINT) AS box_id, CAST(8 AS BIGINT) AS h, CAST(9 AS BIGINT) AS w, CAST(sum(v * {_WEIGHT}) AS BIGINT) AS digest FROM r GROUP BY k""")
def padded_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir, *_SMALL)
    return _told(rasters.crops(images, _boxes(images, "'x0', k % 4 - 2, 'y0', k % 3 - 1, 'x1', k % 4 + 3, 'y1', k % 3 + 3"), ["k"], "box_id", 2), "k", "box_id")


@query(f"""WITH {_pixels(*_SMALL)},
    r AS (SELECT *, CASE WHEN (x >= 1 AND x < 3 AND y >= 1 AND y < 3) OR (x >= k % 5 - 1 AND x < k % 5 + 1 AND y >= 2 AND y < 9) THEN 255 ELSE v END AS n FROM p)
    SELECT k, max(h) AS h, max(w) AS w, CAST(sum(n * {_WEIGHT}) AS BIGINT) AS digest FROM r GROUP BY k""")
def masked_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir, *_SMALL)
    boxes = _boxes(images, "'x0', 1, 'y0', 1, 'x1', 3, 'y1', 3", "'x0', k % 5 - 1, 'y0', 2, 'x1', k % 5 + 1, 'y1', 9")
    return _told(rasters.masked(images, boxes, ["k"]), "k")


@query(f"""WITH {_pixels(*_SMALL)}, {_sampled('(h + 2)', '(w + 3)', '0.5::DOUBLE * y + 0.5::DOUBLE', '0.5::DOUBLE * x + 0.25::DOUBLE')}
    SELECT k, max(oh) AS h, max(ow) AS w, CAST(sum(floor(v) * {_WEIGHT}) AS BIGINT) AS digest FROM r GROUP BY k""")
def warped_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = F.array(*(F.lit(x) for x in (0.5, 0.0, 0.25, 0.0, 0.5, 0.5, 0.0, 0.0, 1.0)))
    return _told(rasters.warped(_images(spark, sf_dir, *_SMALL), matrix, F.col("h") + 2, F.col("w") + 3), "k")


_LINE = ("24", "6 + k % 7")


@query(f"""WITH {_pixels(*_LINE)}, {_sampled('48', '(2 * w)', '(y + 0.5::DOUBLE) / 2 - 0.5::DOUBLE', '(x + 0.5::DOUBLE) / 2 - 0.5::DOUBLE')},
    n AS (SELECT *, CAST(CAST(v AS FLOAT) / 127.5::FLOAT - 1::FLOAT AS DOUBLE) AS z FROM r)
    SELECT k, '3x48x' || (max(ow) + 5) AS shape, round(sum(z * {_WEIGHT}) / (3 * 48 * (max(ow) + 5)), 2) AS digest FROM n GROUP BY k""")
def recogniser_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tensor_told(rasters.line_inputs(_images(spark, sf_dir, *_LINE), F.col("w") * 2, F.col("w") * 2 + 5))


_FORMULA = ("12 + k % 4", "24", "nation", "n_nationkey")


@query(f"""WITH {_pixels(*_FORMULA)}, l AS (SELECT k, h, y, x, sum(v * [0.114, 0.587, 0.299][c + 1]::DOUBLE) AS v FROM p GROUP BY ALL),
    o AS (SELECT k, h, (48 - 2 * h) // 2 AS top, unnest(range(48 * 48)) AS i FROM s), g AS (SELECT *, i // 48 AS y, i % 48 AS x FROM o),
    f AS (SELECT *, least((y - top) / 2.0::DOUBLE, h - 1 - 1e-5::DOUBLE) AS fy, least(x / 2.0::DOUBLE, 23 - 1e-5::DOUBLE) AS fx FROM g WHERE y >= top AND y < top + 2 * h),
    t AS (SELECT *, CAST(floor(fy) AS BIGINT) AS y0, CAST(floor(fx) AS BIGINT) AS x0 FROM f),
    r AS (SELECT t.k, t.y, t.x, (a.v + (b.v - a.v) * (fx - x0)) + ((d.v + (e.v - d.v) * (fx - x0)) - (a.v + (b.v - a.v) * (fx - x0))) * (fy - y0) AS v
          FROM t JOIN l a ON a.k = t.k AND a.y = y0 AND a.x = x0 JOIN l b ON b.k = t.k AND b.y = y0 AND b.x = x0 + 1
            JOIN l d ON d.k = t.k AND d.y = y0 + 1 AND d.x = x0 JOIN l e ON e.k = t.k AND e.y = y0 + 1 AND e.x = x0 + 1),
    n AS (SELECT g.k, g.y, g.x, (coalesce(r.v / 255, 1) - 0.7931::DOUBLE) / 0.1738::DOUBLE AS z FROM g LEFT JOIN r USING (k, y, x))
    SELECT k, '1x48x48' AS shape, round(avg(z * (1 + y * 7 + x * 13)), 2) AS digest FROM n GROUP BY k""")
def formula_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images twice as large, on a square of 48."""
    return _tensor_told(rasters.formula_inputs(_images(spark, sf_dir, *_FORMULA), 48))


_TALL = ("4 + k % 9", "3 + k % 4")


@query(f"""WITH {_pixels(*_TALL)}, u AS (SELECT *, h / w >= 1.5::DOUBLE AS turn FROM p),
    r AS (SELECT k, CASE WHEN turn THEN w ELSE h END AS h, CASE WHEN turn THEN h ELSE w END AS w, CASE WHEN turn THEN w - 1 - x ELSE y END AS y, CASE WHEN turn THEN y ELSE x END AS x, c, v FROM u)
    SELECT k, max(h) AS h, max(w) AS w, CAST(sum(v * {_WEIGHT}) AS BIGINT) AS digest FROM r GROUP BY k""")
def turned_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(rasters.turned(_images(spark, sf_dir, *_TALL)), "k")


@query(f"""WITH {_pixels(*_SMALL)}, r AS (SELECT k, y - 1 AS y, x - k % 3 AS x, c, v FROM p WHERE y >= 1 AND y < 4 AND x >= k % 3 AND x < k % 3 + 4)
    SELECT k, CAST(0 AS BIGINT) AS box_id, CAST(3 AS BIGINT) AS h, CAST(4 AS BIGINT) AS w, CAST(sum(v * {_WEIGHT}) AS BIGINT) AS digest FROM r GROUP BY k""")
def line_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir, *_SMALL)
    boxes = _boxes(images, "'x0', k % 3, 'y0', 1, 'x1', k % 3 + 4, 'y1', 4")
    quads = boxes.select("k", "box_id", scalar.box_quad(F.col("bbox")).alias("quad"))
    return _told(rasters.line_crops(images, quads, ["k"], "box_id"), "k", "box_id")
