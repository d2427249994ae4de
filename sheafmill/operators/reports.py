"""Stage timings, run summaries and hit rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = {"layout": "1_layout", "mfr": "2_mfr", "table_cls": "3_table", "table_orientation": "3_table", "wired_table": "3_table", "wireless_table": "3_table", "ocr_det": "4_ocr_det", "ocr_rec": "5_ocr_rec"}


def stage_report(timings: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """stage, calls, wall_ms and pct from `timings` (stage, wall_ms). `total` is one row of total_ms; if
    that isn't null or 0 it is what pct is of, and a stage `other` holds the rest, 0 at least. The
    per-stage sums are few rows, whatever the number of timings."""
    sums = timings.groupBy("stage").agg(F.count("*").alias("calls"), F.coalesce(F.sum("wall_ms"), F.lit(0.0)).alias("wall_ms"))
    known = sums.agg(F.sum("wall_ms").alias("known_ms"))
    base = known.withColumn("total_ms", F.lit(None).cast("double")) if total is None else known.join(F.broadcast(total.limit(1)), how="left")
    base = base.withColumn("base_ms", F.when(F.coalesce("total_ms", F.lit(0.0)) != 0, F.col("total_ms")).otherwise(F.col("known_ms")))
    rest = base.where("coalesce(total_ms, 0) != 0").select(F.lit("other").alias("stage"), F.lit(1).cast("long").alias("calls"), F.greatest(F.lit(0.0), F.col("total_ms") - F.coalesce("known_ms", F.lit(0.0))).alias("wall_ms"))
    share = F.when(F.col("base_ms") != 0, F.col("wall_ms") / F.col("base_ms") * 100).otherwise(F.lit(0.0))
    # one row each, so that the broadcasts have a fixed size
    return sums.unionByName(rest).join(F.broadcast(base.select("base_ms"))).select("stage", "calls", "wall_ms", share.alias("pct"))


def mapped_stages(timings: DataFrame, kind: str = "kind") -> DataFrame:
    """Timings of model kinds as timings of stages; kinds without a stage are dropped."""
    names = F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair))
    return timings.withColumn("stage", F.try_element_at(names, F.col(kind))).where("stage is not null").drop(kind)


def section_report(timings: DataFrame) -> DataFrame:
    """section, calls, ms and pct of all sections' total, which counts as 1 if it is 0."""
    sums = timings.groupBy("section").agg(F.count("*").alias("calls"), F.sum("ms").alias("ms"))
    total = sums.agg(F.coalesce(F.sum("ms"), F.lit(0.0)).alias("total"))
    share = F.col("ms") / F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("total")) * 100
    return sums.join(F.broadcast(total)).select("section", "calls", "ms", share.alias("pct"))


def run_summary(runs: DataFrame) -> DataFrame:
    """One row of documents, pages, total_ms (of cumulative process_ms, so the largest), seconds a
    document and pages a second, from `runs` (pages, process_ms)."""
    sums = runs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.max("process_ms"), F.lit(0.0)).alias("total_ms"))
    each = F.when(F.col("documents") > 0, F.col("total_ms") / F.col("documents") / 1000).otherwise(F.lit(0.0))
    rate = F.when(F.col("total_ms") > 0, F.col("pages") / (F.col("total_ms") / 1000)).otherwise(F.lit(0.0))
    return sums.select("documents", "pages", "total_ms", each.alias("seconds_a_document"), rate.alias("pages_a_second"))


def speed_up(runs: DataFrame, base: str, fast: str) -> DataFrame:
    """Least and mean ms of two modes of `runs` (mode, ms), their ratio by the least, seconds saved."""
    of = lambda mode, f: f(F.when(F.col("mode") == mode, F.col("ms")))
    sums = runs.agg(of(base, F.min).alias("base_min"), of(base, F.avg).alias("base_avg"), of(fast, F.min).alias("fast_min"), of(fast, F.avg).alias("fast_avg"))
    ratio = F.when(F.col("fast_min") != 0, F.col("base_min") / F.col("fast_min"))
    return sums.withColumns({"speed_up": ratio, "saved_s": (F.col("base_min") - F.col("fast_min")) / 1000})


def hit_rates(calls: DataFrame, key: str = "engine") -> DataFrame:
    """Calls that the fast engine took, and those that fell back."""
    return calls.groupBy(key).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def injected(parts: DataFrame, key: str = "engine") -> DataFrame:
    return parts.groupBy(key).agg(F.countDistinct("part_id").alias("injected"))


def all_passed(builds: DataFrame) -> DataFrame:
    return builds.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))


def with_batch_table(results: DataFrame, table: DataFrame, key: str = "doc_index") -> DataFrame:
    """Results of a run, of which the first alone carries the run's table (stage, calls, wall_ms, pct) as
    batch_table, in order of stages; a run has few stages."""
    row = table.agg(F.sort_array(F.collect_list(F.struct("stage", "calls", "wall_ms", "pct"))).alias("t")).scalar()
    first = results.agg(F.min(key)).scalar()
    return results.withColumn("batch_table", F.when(F.col(key) == first, row))


def formula_cost(timings: DataFrame) -> DataFrame:
    """Microseconds a formula, from `timings` (seconds, formulas)."""
    sums = timings.agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.coalesce(F.sum("formulas"), F.lit(0)).alias("formulas"))
    return sums.withColumn("us_a_formula", F.col("seconds") / F.greatest(F.lit(1), F.col("formulas")) * 1e6)
