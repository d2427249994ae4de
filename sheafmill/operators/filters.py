"""Filters and projections of layout items. A predicate that is null drops a row as in SQL, unless said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar

#: Fragments that a recogniser makes of noise; full-width brackets are meant.
NOISE = tuple("c 号 :) c) （2 -: i:) √:) （20 （2号 cd:) id:) -i:) √i:) （204 （20号 (cd:) (ci:) （204号 (cd:1) (cid:)".split())
FORMULAS = ("display_formula", "inline_formula")
DET_ALGORITHMS, REC_ALGORITHMS = ("DB", "DB++"), ("CRNN", "SVTR_LCNet", "SVTR_HGNet")


def known_algorithm(kind: Column, algorithm: Column) -> Column:
    """Whether a detector's or recogniser's algorithm is one that the batch stages can take."""
    return ((kind == "det") & algorithm.isin(*DET_ALGORITHMS)) | ((kind == "rec") & algorithm.isin(*REC_ALGORITHMS))


def formulas(items: DataFrame) -> DataFrame:
    return items.where(F.col("label").isin(*FORMULAS)).withColumn("latex", F.coalesce("latex", F.lit("")))


def without_inline_formulas(items: DataFrame) -> DataFrame:
    """Items for a run with formulas off; a null label stays."""
    return items.where(~F.col("label").eqNullSafe("inline_formula"))


def confident(items: DataFrame, least: float) -> DataFrame:
    return items.where(F.col("score") >= least)


def wide_enough(items: DataFrame, quad: str, least: float) -> DataFrame:
    return items.where(F.col(quad)[2]["x"] - F.col(quad)[0]["x"] >= least)


def boxed(items: DataFrame) -> DataFrame:
    return items.where(F.col("bbox").isNotNull())


def is_noise(text: Column, score: Column, width: Column, height: Column, least: float) -> Column:
    """Too uncertain, or a known fragment of low score that is taller than wide."""
    return (score < least) | (text.isin(*NOISE) & (score < 0.8) & (width < height))


def without_noise(items: DataFrame, least: float) -> DataFrame:
    """Recognised items that aren't noise; a null text or score is kept only if it is surely none."""
    bbox = F.col("bbox")
    noise = is_noise(F.col("text"), F.col("score"), scalar.box_width(bbox), scalar.box_height(bbox), least)
    return items.where(~F.coalesce(noise, F.col("score").isNull()))


def as_ocr_text(items: DataFrame, ocr_enable: Column) -> DataFrame:
    """Items as recognised text: a fixed score where recognition is on, else the score, a double, to two
    places by its binary value."""
    return items.withColumns({"label": F.lit("ocr_text"), "score": F.when(ocr_enable, F.lit(1.0)).otherwise(scalar.rounded(F.col("score"), 2))})


def three_places(score: Column) -> Column:
    """The score as its decimal print with three places reads."""
    return scalar.rounded(score, 3)


def seals(items: DataFrame, texts: str = "seal_texts") -> DataFrame:
    """Seals with a box, their texts without empty ones."""
    kept = F.filter(F.coalesce(F.col(texts), F.array().cast("array<string>")), lambda t: t != "")
    return items.where((F.col("label") == "seal") & F.col("bbox").isNotNull()).withColumn(texts, kept)


def wired_tables(tables: DataFrame) -> DataFrame:
    """Tables for the wired model: wired ones and unsure wireless ones that have recognised text,
    without the classifier's columns."""
    wired = ((F.col("cls_label") == "WirelessTable") & (F.col("cls_score") < 0.9)) | (F.col("cls_label") == "WiredTable")
    read = F.size(F.coalesce("ocr_result", F.array())) > 0
    return tables.where(wired & read).drop("cls_label", "cls_score")


def with_regions(pages: DataFrame, regions: str) -> DataFrame:
    return pages.where(F.size(regions) > 0)


def with_inline_objects(tables: DataFrame, supported: Column, objects: str) -> DataFrame:
    return tables.where(supported & (F.size(objects) > 0))


def croppable(width: Column, height: Column) -> Column:
    return (width >= 2) & (height >= 2)


def ocr_enabled(method: Column, automatic: Column) -> Column:
    """Whether a document is recognised: as its method says, by `automatic` for others."""
    return F.when(method == "ocr", F.lit(True)).when(method == "txt", F.lit(False)).otherwise(automatic)


def pruned(items: DataFrame, ocr_enable: Column, text: str = "text") -> DataFrame:
    """Items without recognised text that stayed empty."""
    empty = (F.col("label") == "ocr_text") & (F.coalesce(F.col(text), F.lit("")) == "")
    return items.where(~(ocr_enable & F.coalesce(empty, F.lit(False))))
