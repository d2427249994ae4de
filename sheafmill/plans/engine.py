"""The engine: documents to windows to pages to models to results, each a DataFrame.

Pages are rendered once to the run's work folder, as are the results of the layout and of each recogniser;
later stages read them from there, so a lost executor costs no rendering. Everything a stage
gathers is by page or document, which bounds it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import filters, models, rasters, reports, stages, windows
from ..operators.stages import KEY, PAGE
from ..sources import files, sinks, storage
from . import nets
from .config import Settings


def count_marks(content: bytes) -> int:
    """Pages of a simple PDF, by its page objects; a stand-in where no PDF library is installed."""
    return content.count(b"/Type /Page") - content.count(b"/Type /Pages")


def render_nothing(path: str, content: bytes | None, first: int, last: int) -> list[files.Page]:
    """A renderer that gives empty pages."""
    return [(b"", None) for _ in range(first, last + 1)]


class Engine:
    """Reads documents, plans windows over them, runs a run's models and writes results per document.

    `render` gives pages of h x w x 3 bytes; where it fails and there is `by_bytes`, that is given the
    document's content. Closing an engine removes its work folders, and with them what its frames read.
    """

    def __init__(self, spark: SparkSession, settings: Settings | None = None, count: Callable[[bytes], int] = count_marks, render: files.Renderer = render_nothing, by_bytes: files.Renderer | None = None, make: nets.Factory = nets.nothing) -> None:
        self.spark, self.settings = spark, (settings or Settings()).resolved()
        self._count, self._render, self._by_bytes = count, render, by_bytes
        self.engines = files.existing(self.settings.engines())
        self.nets = make(self.engines, self.settings)
        self._work = f"{self.settings.output_dir}/_work/{uuid.uuid4().hex}"
        self._n, self.timings = 0, []

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        storage.remove(self._work)

    # -- steps -----------------------------------------------------------------------------------

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        """Written to the work folder and read again; a stage of the run's timings."""
        self._n += 1
        path, began = f"{self._work}/{self._n:03d}-{name}", time.monotonic()
        rows.write.mode("overwrite").parquet(path)
        self.timings.append((name, (time.monotonic() - began) * 1000))
        return self.spark.read.schema(rows.schema).parquet(path)

    def _applied(self, rows: DataFrame, name: str, batch: int = 1) -> DataFrame:
        """Rows with what a model adds, a given number of tasks, as few rows are much work."""
        added = nets.ADDED[name]
        columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
        loader, tasks = getattr(self.nets, name), 4 * self.spark.sparkContext.defaultParallelism

        def beside() -> models.Model:
            model = loader()
            return lambda part: pd.concat([part.reset_index(drop=True), model(part).reset_index(drop=True)], axis=1)

        return models.apply_model(rows.repartition(tasks, *(c for c in KEY if c in rows.columns)), (self._work, name), beside, ", ".join([*columns, added]), max(1, batch * self.settings.batch_ratio), self._blank(rows))

    def _blank(self, rows: DataFrame) -> pd.DataFrame | None:
        """White pages that warm a model up, with nothing in other columns."""
        n = self.settings.warm_up_pages
        row: dict = {f.name: [] if f.dataType.typeName() == "array" else None for f in rows.schema.fields}
        row |= {"h": 32, "w": 32, "data": b"\xff" * (32 * 32 * 3)}
        return pd.DataFrame([row] * n) if n else None

    def read(self, targets: str | Sequence[str]) -> DataFrame:
        """doc_index, path, name and page_count of the documents of one or more targets, each once; written
        once, so that all later steps see one list of files. Contents don't leave the tasks that read them."""
        several = [targets] if isinstance(targets, str) else list(targets)
        found = reduce(DataFrame.union, (files.scan(self.spark, t, content=True) for t in several))
        counted = self._kept(files.page_counts(found, self._count).select("path", "name", F.col("page_count").cast("long").alias("page_count")), "counts")
        return self._kept(files.numbered(counted.dropDuplicates(["path"])), "documents")

    def plan(self, documents: DataFrame) -> DataFrame:
        return windows.plan_windows(documents, self.settings.window_pages)

    def pages(self, documents: DataFrame) -> DataFrame:
        """doc_index, page_index, lang, ocr_enable, chars, h, w and data of all pages, a task's work being
        page ranges. By itself, a document is recognised if no page of it has characters."""
        segments = self.plan(documents).join(documents.select("doc_index", "path"), "doc_index")
        ranges = segments.select("path", F.col("page_start").cast("int").alias("first"), (F.col("page_start") + F.col("take") - 1).cast("int").alias("last"))
        made = files.pages(ranges, self._render, self._by_bytes, self.settings.render_seconds)
        made = self._kept(made.join(documents.select("doc_index", "path"), "path"), "render")
        scanned = made.groupBy("doc_index").agg((F.count("chars") == 0).alias("scanned"))
        enabled = filters.ocr_enabled(F.lit(self.settings.method), F.col("scanned"))
        return made.join(scanned, "doc_index").select(*PAGE, F.lit(self.settings.lang).alias("lang"), enabled.alias("ocr_enable"), "chars", "h", "w", F.col("image").alias("data"))

    def _crops(self, pages: DataFrame, items: DataFrame, paste: int = scalar.PASTE) -> DataFrame:
        """KEY and image of each item's padded box."""
        return rasters.crops(pages, items.select(*KEY, "bbox"), PAGE, "item_idx", paste)

    def layout(self, pages: DataFrame) -> DataFrame:
        """Items (KEY, label, bbox, score, text, latex, html) of all pages, after the split of the models."""
        found = self._applied(pages.select(*PAGE, "chars", "h", "w", "data"), "layout").select(*PAGE, F.posexplode("items").alias("item_idx", "i"))
        items = found.select(*KEY, "i.*", F.lit(None).cast("string").alias("latex"), F.lit(None).cast("string").alias("html"))
        return self._kept(models.expect_columns(self.nets.split(items), f"doc_index long, page_index int, item_idx int, label string, bbox {nets.BOX}, latex string"), "layout")

    def formulas(self, pages: DataFrame, items: DataFrame) -> DataFrame:
        """All items, formulas with their latex, which are decoded in chunks of like area."""

        def decode(formulas: DataFrame) -> DataFrame:
            area = scalar.box_area(F.col("bbox")).alias("area")
            rows = self._crops(pages, formulas).join(formulas.select(*KEY, area), list(KEY))
            rows = rows.withColumn("formula_id", F.struct(*KEY))
            place = (F.col("doc_index") * (1 << 20) + F.col("page_index")).cast("double")
            chunks = windows.sorted_chunks(rows, "area", "formula_id", max(1, 32 * self.settings.batch_ratio), "chunk", place)
            return models.apply_in_batches(chunks.drop("formula_id"), ["chunk"], ["area", *KEY], (self._work, "formula"), self.nets.formula, nets.ADDED["formula"], self._blank(chunks))

        return self._kept(stages.formula_stage(items, decode, self.settings.formulas), "formula")

    def lines(self, pages: DataFrame, items: DataFrame) -> DataFrame:
        """Recognised lines of the text regions."""

        def detect(crops: DataFrame) -> DataFrame:
            found = self._applied(self._crops(pages, crops.select(*KEY, scalar.box(*(F.col(f"crop.{c}") for c in ("xmin", "ymin", "xmax", "ymax"))).alias("bbox"))), "detect")
            lines = found.select(*KEY, F.posexplode("quads").alias("n", "quad"))
            lines = lines.select(*KEY, F.struct(*KEY, "n").alias("line_id"), "quad")
            merged = self.nets.update(self.nets.merge(lines), items.where(F.col("label").isin(*filters.FORMULAS)))
            return self._kept(models.expect_columns(merged.select(*KEY, "line_id", "quad"), f"doc_index long, quad {nets.QUADS[6:-1]}"), "detect")

        meta = pages.select(*PAGE, "lang", "ocr_enable", F.col("w").alias("width"), F.col("h").alias("height"))
        crop = lambda lines: rasters.line_crops(pages, lines.select(*PAGE, "line_id", "quad"), PAGE, "line_id").select("line_id", "h", F.col("w").alias("crop_w"), "data")
        return self._kept(stages.text_stage(items, meta, detect, self.nets.reader, self.settings.min_confidence, self.settings.min_width, crop, (self._work, "reader"), self.settings.rec_items, self.settings.rec_budget), "reader")

    def tables(self, pages: DataFrame, items: DataFrame, lines: DataFrame) -> DataFrame:
        """Tables (KEY) with html: turned upright, classified, with the lines that lie in them and inline
        formulas as cells, through the wireless model and, where routed, the wired one."""
        boxes = items.where((F.col("label") == "table") & F.col("bbox").isNotNull())
        if not self.settings.tables:
            return boxes.limit(0).select(*KEY, "html")
        seen = self._kept(self._applied(self._crops(pages, boxes, 0), "classify"), "classify")
        images = rasters.quarter_turned(seen, F.coalesce("turns", F.lit(0))).select(*KEY, "h", "w", "data", "cls_label", "cls_score")
        found = [lines.select(*PAGE, "bbox", "text"), items.where("label = 'inline_formula'").select(*PAGE, "bbox", F.concat(F.lit("$"), F.coalesce("latex", F.lit("")), F.lit("$")).alias("text"))]
        cells, inline = (self._inside(rows, boxes) for rows in found)
        html = lambda name: lambda rows: self._applied(rows, name)
        return self._kept(stages.table_stage(images, cells, html("wireless"), html("wired"), inline), "tables")

    @staticmethod
    def _inside(rows: DataFrame, boxes: DataFrame) -> DataFrame:
        """KEY of a table, order and text of the rows whose centre lies in its box, of the same page."""
        centre = lambda a, b: F.floor((F.col(f"l.bbox.{a}") + F.col(f"l.bbox.{b}")) / 2)
        same = [F.col(f"l.{c}") == F.col(f"t.{c}") for c in PAGE]
        joined = rows.alias("l").join(boxes.select(*KEY, "bbox").alias("t"), [*same, scalar.contains_pixel(F.col("t.bbox"), centre("x0", "x1"), centre("y0", "y1"))])
        return joined.select(*(f"t.{c}" for c in KEY), F.struct("l.bbox.y0", "l.bbox.x0").alias("order"), "l.text")

    def seals(self, pages: DataFrame, items: DataFrame) -> DataFrame:
        return self._kept(stages.seal_stage(items, lambda boxes: self._applied(self._crops(pages, boxes), "seal")), "seals")

    def analyze(self, documents: DataFrame) -> DataFrame:
        """doc_index, page_index and blocks of all pages. Lines that lie in a table are its cells; the text
        of pages that aren't recognised is that of their characters."""
        pages = self.pages(documents)
        items = self.formulas(pages, self.layout(pages))
        lines = self.lines(pages, items)
        tables = self.tables(pages, items, lines)
        inside = [F.col(f"l.{c}") == F.col(f"t.{c}") for c in PAGE] + [scalar.contains_pixel(F.col("t.bbox"), *(F.floor((F.col(f"l.bbox.{v}0") + F.col(f"l.bbox.{v}1")) / 2) for v in "xy"))]
        boxes = items.join(tables.select(*KEY), list(KEY), "left_semi").select(*PAGE, "bbox")
        free = lines.alias("l").join(boxes.alias("t"), inside, "left_anti").join(pages.where("ocr_enable").select(*PAGE), list(PAGE), "left_semi")
        # a page's characters are one block, above all others
        typed = pages.where("not ocr_enable and chars != ''").select(*PAGE, F.lit("text").alias("label"), F.lit(None).cast(nets.BOX).alias("bbox"), F.col("chars").alias("text"))
        blocks = stages.page_blocks(items, free.select(*PAGE, "label", "bbox", "text").unionByName(typed), tables, self.seals(pages, items))
        sized = pages.select(*PAGE, "w", "h").join(blocks, list(PAGE), "left")
        return self._kept(sized.select(*PAGE, "w", "h", F.coalesce("blocks", F.array().cast(blocks.schema["blocks"].dataType)).alias("blocks")), "blocks")

    def assemble(self, documents: DataFrame, blocks: DataFrame, items: DataFrame | None = None) -> DataFrame:
        """One result per document, documents without pages included: its middle result, content list and
        Markdown. A document's pages are what its own result holds, so gathering them is bounded by it."""
        page = F.struct("page_index", "w", "h", "blocks")
        gathered = blocks.groupBy("doc_index").agg(F.sort_array(F.collect_list(page)).alias("pages"))
        empty = F.array().cast(gathered.schema["pages"].dataType)
        joined = documents.join(gathered, "doc_index", "left").withColumn("pages", F.coalesce("pages", empty))
        info = F.transform("pages", lambda p: F.struct(p["page_index"].alias("page_idx"), F.array(p["w"], p["h"]).alias("page_size"), p["blocks"].alias("blocks")))
        listed = F.flatten(F.transform("pages", lambda p: F.transform(p["blocks"], lambda b: F.struct(b["label"].alias("type"), b["content"].alias("content"), b["bbox"].alias("bbox"), p["page_index"].alias("page_idx")))))
        marked = F.array_join(F.filter(F.transform(listed, lambda b: _markdown(b["type"], b["content"])), lambda t: t != ""), "\n\n")
        folder = sinks.output_dir(self.settings.output_dir, F.col("path"), F.lit(self.settings.method))
        return joined.select("doc_index", "path", "name", folder.alias("folder"), F.to_json(F.struct(info.alias("pdf_info"))).alias("middle_json"), F.to_json(listed).alias("content_list"), marked.alias("markdown"), F.to_json(info).alias("model_json"))

    # -- runs ------------------------------------------------------------------------------------

    def process_many(self, targets: Sequence[str], on_done: Callable[[Row], None] | None = None) -> DataFrame:
        """Process and write all documents of the targets; doc_index, name, output_dir, pages and process_ms of each, which
        counts from the start of the run to when its files were written. `on_done` is called with each of
        these rows, those of documents without pages first. A run that is repeated writes the same files."""
        began = time.time()
        documents = self.read(targets)
        results = self.assemble(documents, self.analyze(documents))
        written = sinks.write_documents(results, self.settings.render).join(documents.select("doc_index", "name", "page_count"), "doc_index")
        runs = self._kept(written.select("doc_index", "name", F.col("folder").alias("output_dir"), F.col("page_count").alias("pages"), ((F.col("written") - began) * 1000).alias("process_ms")), "output")
        if on_done:
            for row in runs.orderBy(F.col("pages") > 0, "process_ms", "doc_index").toLocalIterator():
                on_done(row)
        return runs

    def process(self, target: str) -> DataFrame:
        return self.process_many([target])

    def stage_report(self) -> DataFrame:
        """Wall time by stage of all that has run."""
        return reports.stage_report(self.spark.createDataFrame(self.timings, "stage string, wall_ms double"))


def _markdown(label: Column, content: Column) -> Column:
    content = F.coalesce(content, F.lit(""))
    formula = F.when(label == "inline_formula", F.concat(F.lit("$"), content, F.lit("$"))).otherwise(F.concat(F.lit("$$\n"), content, F.lit("\n$$")))
    return F.when(content == "", "").when(label.isin(*filters.FORMULAS), formula).otherwise(content)
