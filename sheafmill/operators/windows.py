"""Page windows over document boundaries, and batches of items under a budget.

`documents` has doc_index (unique, an integer) and page_count; lines have a group, an id and a width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import row_rank, running_sum

PAGES = 64
#: The most items of a batch, and its number of items times its widest width.
ITEMS, BUDGET = 6, 5120


def plan_windows(documents: DataFrame, pages: int = PAGES) -> DataFrame:
    """window_id, doc_index, page_start and take: windows of `pages` pages filled in document order,
    across documents. A null or negative page count is 0; such documents have no segments."""
    counted = documents.select(F.col("doc_index").cast("long"), F.greatest(F.coalesce("page_count", F.lit(0)), F.lit(0)).cast("long").alias("page_count"))
    placed = running_sum(counted, "doc_index", F.col("page_count"), "start").where("page_count > 0")
    first, last = F.floor(F.col("start") / pages), F.floor((F.col("start") + F.col("page_count") - 1) / pages)
    segments = placed.withColumn("window_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("window_id") * pages)
    end = F.least(F.col("start") + F.col("page_count"), (F.col("window_id") + 1) * pages)
    return segments.select("window_id", "doc_index", (begin - F.col("start")).alias("page_start"), (end - begin).alias("take"))


def pages_of(segments: DataFrame) -> DataFrame:
    """window_id, doc_index and page_index of each page of the segments."""
    last = F.col("page_start") + F.col("take") - 1
    return segments.select("window_id", "doc_index", F.explode(F.sequence("page_start", last)).alias("page_index"))


def segment_offsets(segments: DataFrame) -> DataFrame:
    """Segments with the offset of their first page within their window. A window holds so few pages
    that it has few segments, so an ordinary window function is bounded."""
    before = Window.partitionBy("window_id").orderBy("doc_index").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("offset", F.coalesce(F.sum("take").over(before), F.lit(0)))


def zero_page_documents(documents: DataFrame) -> DataFrame:
    """Documents that are emitted before any window."""
    return documents.where(F.coalesce("page_count", F.lit(0)) <= 0)


def completion_windows(documents: DataFrame, pages: int = PAGES) -> DataFrame:
    """doc_index, its pages and the window in which the last of them is done; null without pages."""
    done = plan_windows(documents, pages).groupBy("doc_index").agg(F.sum("take").alias("pages_done"), F.max("window_id").alias("final_window"))
    whole = documents.select(F.col("doc_index").cast("long"), "page_count").join(done, "doc_index", "left")
    return whole.select("doc_index", F.coalesce("pages_done", F.lit(0)).alias("pages_done"), "final_window")


def adaptive_batches(lines: DataFrame, group: str = "lang", id_col: str = "line_id", width: str = "w", items: int = ITEMS, budget: int = BUDGET, place: Column | None = None) -> DataFrame:
    """`lines` with batch_id and padded_w: within a group, by width and id, a batch takes the next line
    while it has fewer than `items` and its number of lines times the new width is within budget; a
    line over the budget is a batch of its own, and lines of width 0 are limited by `items` alone.

    Equal widths make runs, and only the counts of runs are folded in order: a group has as many as
    there are different widths. A line's batch follows from its run's state and its place in the run,
    so no task sees a whole group, and equal widths may be any share of the rows.
    """
    within = F.when(F.col(width) > 0, F.floor(F.lit(budget) / F.col(width)).cast("int")).otherwise(F.lit(items))
    cap = F.greatest(F.lit(1), F.least(F.lit(items), within))
    runs = lines.groupBy(group, width).agg(F.count("*").alias("n")).withColumn("cap", cap)
    ordered = runs.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(width).alias("w"), "n", "cap"))).alias("runs"))
    # the state before a run: batches opened so far, and the lines of the last one
    start = F.struct(F.lit(0).cast("long").alias("opened"), F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<w:long,opened:bigint,held:bigint,cap:bigint>>").alias("out"))

    def step(state, run):
        fill = F.when(state["opened"] > 0, F.least(run["n"], F.greatest(run["cap"] - state["held"], F.lit(0)))).otherwise(F.lit(0)).cast("long")
        rest = run["n"] - fill
        new = F.ceil(rest / run["cap"]).cast("long")
        held = F.when(new > 0, rest - (new - 1) * run["cap"]).otherwise(state["held"] + fill)
        row = F.struct(run["w"].cast("long").alias("w"), state["opened"].alias("opened"), state["held"].alias("held"), run["cap"].cast("long").alias("cap"))
        return F.struct((state["opened"] + new).cast("long").alias("opened"), held.cast("long").alias("held"), F.concat(state["out"], F.array(row)).alias("out"))

    states = ordered.select(group, F.explode(F.aggregate("runs", start, step, lambda s: s["out"])).alias("s"))
    states = states.select(group, F.col("s.w").alias(width), F.col("s.opened").alias("opened"), F.col("s.held").alias("held"), F.col("s.cap").alias("cap"))
    ranked = row_rank(lines.withColumn(width, F.col(width).cast("long")), id_col, "rank", (group, width), place=place).join(states, [group, width])
    fill = F.when(F.col("opened") > 0, F.greatest(F.col("cap") - F.col("held"), F.lit(0))).otherwise(F.lit(0))
    batch = F.when(F.col("rank") < fill, F.col("opened") - 1).otherwise(F.col("opened") + F.floor((F.col("rank") - fill) / F.col("cap")))
    placed = ranked.select(*lines.columns, batch.cast("long").alias("batch_id"))
    widest = placed.groupBy(group, "batch_id").agg(F.max(width).alias("padded_w"))
    return placed.join(widest, [group, "batch_id"]).select(*lines.columns, "batch_id", "padded_w")


def sorted_chunks(rows: DataFrame, order: str, key: str, size: int, name: str = "chunk_id", place: Column | None = None) -> DataFrame:
    """`rows` with the number of their chunk of `size` rows in order of `order`, a number of which a third
    of the rows may have the same, and `key`, which is unique (with a `place`, if it is no number); a null
    order counts as 0."""
    filled = rows.withColumn("__order", F.coalesce(F.col(order).cast("double"), F.lit(0.0)))
    starts = running_sum(filled.groupBy("__order").agg(F.count("*").alias("__n")), "__order", F.col("__n"), "__before")
    ranked = row_rank(filled, key, "__rank", ("__order",), place=place).join(starts.select("__order", "__before"), "__order")
    return ranked.select(*rows.columns, F.floor((F.col("__before") + F.col("__rank")) / size).alias(name))


def fixed_chunks(rows: DataFrame, key: str, size: int, name: str = "chunk_id") -> DataFrame:
    """`rows` with the number of their chunk of `size` rows in order of `key`."""
    ranked = row_rank(rows, key, "__rank")
    return ranked.select(*rows.columns, F.floor(F.col("__rank") / size).alias(name))
