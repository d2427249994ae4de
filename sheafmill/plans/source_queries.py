"""Scans, lookups and filters that `queries` has no query of, over stand-ins of the right shape, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, text
from ..operators import filters, routing, stages
from ..sources import files
from .config import Settings
from .engine import Engine
from .queries import _ITEMS_SQL, _LINES_OF, _items, _table, query

_TABLES = sorted("benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split())


@query(f"SELECT CAST(doc_index AS BIGINT) AS doc_index, name FROM (VALUES {', '.join(f'({k}, {name!r})' for k, name in enumerate(_TABLES))}) AS t(doc_index, name)")
def document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables themselves, files or folders of files, numbered by path."""
    found = files.in_folders(files.scan(spark, sf_dir, pattern="*.parquet"), sf_dir, ".parquet")
    return files.numbered(found).select("doc_index", "name")


@query("""SELECT doc_id AS doc_index, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) END AS page_count FROM documents""")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a document counted by its bytes; a fifth of them can't be read."""
    content = F.when(F.col("doc_id") % 5 != 0, F.col("text").cast("binary"))
    counted = files.page_counts(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_index"), content.alias("content")), lambda c: c.count(b"e"))
    return counted.select("doc_index", F.col("page_count").cast("long").alias("page_count"))


_RANGES = """r AS (SELECT doc_id, n_chars // 200 AS n, unnest(range(0, n_chars // 200, 5)) AS first FROM documents)"""


@query(f"WITH {_RANGES} SELECT 'doc-' || doc_id AS path, CAST(first AS BIGINT) AS first, CAST(least(first + 5, n) - 1 AS BIGINT) AS last FROM r")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_ranges(spark, sf_dir).select("path", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def _page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("path"), F.expr("CAST(n_chars div 200 AS int)").alias("page_count"))
    return files.page_ranges(docs, 5)


def _render(path: str, content: bytes | None, first: int, last: int) -> list[tuple[bytes, str | None]]:
    """A stand-in that can't read every third document, and has no characters of pages ten times eleven."""
    if content is None and int(path.removeprefix("doc-")) % 3 == 0:
        raise OSError(path)
    return [(b"%d" % k, None if k % 11 == 10 else f"{path}/{k}") for k in range(first, last + 1)]


@query(f"""WITH {_RANGES}, p AS (SELECT doc_id, first, unnest(range(first, least(first + 5, n))) AS k FROM r)
    SELECT 'doc-' || doc_id AS path, CAST(k AS BIGINT) AS page_index, CAST(k AS VARCHAR) AS image,
           CASE WHEN bool_or(k % 11 = 10) OVER (PARTITION BY doc_id, first) THEN NULL ELSE 'doc-' || doc_id || '/' || k END AS chars FROM p""")
def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by range, where a failing renderer falls back on bytes and one page without characters
    takes those of its range."""
    pages = files.pages(_page_ranges(spark, sf_dir), _render, _render, fetch=lambda path: b"bytes")
    return pages.select("path", F.col("page_index").cast("long").alias("page_index"), F.col("image").cast("string").alias("image"), "chars")


@query("SELECT doc_id AS doc_index, 0 AS page_index, CASE WHEN doc_id % 2 = 0 THEN lang || doc_id ELSE upper(source) END AS chars FROM documents")
def cached_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_index"), F.lit(0).alias("page_index"), "lang", "source")
    cached = rows.where("doc_index % 2 = 0").select("doc_index", "page_index", F.concat("lang", "doc_index").alias("chars"))
    return files.with_cached_chars(rows, cached, F.upper("source")).select("doc_index", "page_index", "chars")


@query("SELECT CAST(k AS BIGINT) AS page_index, CAST(768 * 1024 * 3 AS BIGINT) AS size, repeat('FF', 6) AS first FROM range(3) AS t(k)")
def warm_up_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = files.blank_pages(spark, Settings(warm_up_pages=3).warm_up_pages)
    return made.select(F.col("page_index").cast("long").alias("page_index"), F.octet_length("image").cast("long").alias("size"), F.hex(F.substring("image", 1, 6)).alias("first"))


@query("""SELECT event_type AS mode, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 3 = 0""")
def worker_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked lines among others, and lines with the mark elsewhere."""
    record = F.concat(F.lit('{"mode":"'), "event_type", F.lit('","k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    mark = F.when(F.col("event_id") % 3 == 0, files.RESULT_MARK).when(F.col("event_id") % 3 == 1, "x" + files.RESULT_MARK).otherwise("")
    return files.worker_results(_table(spark, sf_dir, "events").select(F.concat(mark, record).alias("value")), "mode string, k long")


@query(f"""SELECT doc_id, CAST(len(x) AS BIGINT) AS n, coalesce(x[len(x)], '') AS last FROM (SELECT doc_id, {_LINES_OF.format('t')} AS x FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || chr(13) WHEN 1 THEN replace(text, '. ', chr(12)) WHEN 2 THEN chr(10) ELSE '' END AS t FROM documents))""")
def program_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.expr("CASE doc_id % 4 WHEN 0 THEN text || chr(13) WHEN 1 THEN replace(text, '. ', chr(12)) WHEN 2 THEN chr(10) ELSE '' END")
    rows = _table(spark, sf_dir, "documents").select("doc_id", text.lines(made).alias("x"))
    return rows.select("doc_id", F.size("x").cast("long").alias("n"), F.coalesce(F.get("x", F.size("x") - 1), F.lit("")).alias("last"))


# -- filters and lookups -------------------------------------------------------------------------


_CLAMPED = "greatest(0, least({}, 640)) AS {}"


@query(f"""WITH i AS ({_ITEMS_SQL}), c AS (SELECT page, item_idx, {', '.join(_CLAMPED.format(v, v) for v in ('x0', 'y0', 'x1', 'y1'))} FROM i) SELECT * FROM c WHERE x1 > x0 AND y1 > y0""")
def clamped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes inside their page of 640 pixels; what lies outside has none and goes."""
    rows = _items(spark, sf_dir).withColumn("bbox", scalar.clamp_box(F.col("bbox"), 640, 640))
    return filters.boxed(rows).select("page", "item_idx", *(F.col(f"bbox.{k}").cast("long").alias(k) for k in ("x0", "y0", "x1", "y1")))


@query(f"WITH i AS ({_ITEMS_SQL}) SELECT page, item_idx FROM i WHERE x1 - x0 >= 2 AND y1 - y0 >= 2")
def croppable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bbox")
    return _items(spark, sf_dir).where(filters.croppable(scalar.box_width(b), scalar.box_height(b))).select("page", "item_idx")


@query(f"""WITH i AS ({_ITEMS_SQL}), p AS (SELECT page, count(*) FILTER (label = 'ocr_text') AS n FROM i GROUP BY page) SELECT page, n FROM p WHERE n > 0""")
def pages_with_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _items(spark, sf_dir).groupBy("page").agg(F.collect_list(F.when(F.col("label") == "ocr_text", F.col("item_idx"))).alias("regions"))
    return filters.with_regions(pages, "regions").select("page", F.size("regions").cast("long").alias("n"))


@query(f"""WITH i AS ({_ITEMS_SQL}), f AS (SELECT page, string_agg(item_idx, ',' ORDER BY item_idx) AS cells FROM i WHERE label = 'inline_formula' GROUP BY page)
    SELECT o_orderkey AS page, cells FROM orders JOIN f ON o_orderkey = page WHERE o_orderkey % 3 <> 0""")
def table_inline_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline objects by table, none where there are none, and tables that take them."""
    tables = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    found = _items(spark, sf_dir).where("label = 'inline_formula'").groupBy("page").agg(F.sort_array(F.collect_list("item_idx")).alias("objects"))
    rows = routing.with_default(tables, found, ["page"], "objects")
    kept = filters.with_inline_objects(rows, F.col("page") % 3 != 0, "objects")
    return kept.select("page", F.array_join(F.col("objects").cast("array<string>"), ",").alias("cells"))


@query(f"""WITH i AS ({_ITEMS_SQL}) SELECT page, string_agg(item_idx || ':' || part, ',' ORDER BY part % 97, item_idx) AS cells FROM i WHERE label IN ('ocr_text', 'inline_formula') GROUP BY page""")
def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised cells and inline objects of a table as one list in order."""
    rows = _items(spark, sf_dir).where("label in ('ocr_text', 'inline_formula')")
    cell = F.struct(F.struct(F.col("part") % 97, "item_idx").alias("order"), F.concat_ws(":", "item_idx", "part").alias("text"))
    of = lambda label: F.collect_list(F.when(F.col("label") == label, cell))
    lists = rows.groupBy("page").agg(of("ocr_text").alias("cells"), of("inline_formula").alias("objects"))
    merged = routing.merged_cells(F.col("cells"), F.col("objects"))
    return lists.select("page", F.array_join(F.transform(merged, lambda c: c["text"]), ",").alias("cells"))


@query(f"""WITH i AS ({_ITEMS_SQL}), t AS (SELECT *, CASE WHEN part % 4 = 0 THEN '' WHEN part % 4 = 1 THEN NULL ELSE 'x' END AS text FROM i)
    SELECT page, item_idx FROM t WHERE NOT (page % 2 = 0 AND coalesce(label = 'ocr_text', false) AND coalesce(text, '') = '')""")
def pruned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).withColumn("text", F.when(F.col("part") % 4 == 0, "").when(F.col("part") % 4 != 1, "x"))
    return filters.pruned(rows, F.col("page") % 2 == 0).select("page", "item_idx")


@query("""SELECT p_partkey, (p_partkey % 2 = 0 AND p_size % 4 IN (0, 1)) OR (p_partkey % 2 = 1 AND p_size % 4 IN (2, 3)) AS taken FROM part""")
def known_algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 2 == 0, "det").otherwise("rec")
    name = F.element_at(F.array(*(F.lit(n) for n in ("DB", "DB++", "CRNN", "SVTR_LCNet"))), (F.col("p_size") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", filters.known_algorithm(kind, name).alias("taken"))


@query("SELECT lang, doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'r' || n_chars END AS result FROM documents")
def results_by_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results back at their inputs by group and ordinal, in whatever order they come; some have none."""
    inputs = _table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    results = inputs.where("doc_id % 3 <> 0").select("lang", "doc_id", F.concat(F.lit("r"), "n_chars").alias("result")).orderBy(F.xxhash64("doc_id"))
    return routing.by_ordinal(inputs.select("lang", "doc_id"), results, ["lang", "doc_id"])


@query("""WITH z AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)
    SELECT conv_id, turn, array_to_string([w[i] || ':' || length(w[i]) FOR i IN range(1, len(w) + 1)], ',') AS pairs FROM z""")
def zipped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of one length, of inputs and of results, pair by pair."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    pairs = routing.zipped(F.col("w"), F.transform("w", F.length), ("word", "n"))
    return rows.select("conv_id", "turn", F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["word"], p["n"])), ",").alias("pairs"))


def _blocks(spark: SparkSession, sf_dir: str, doc: str, page: str) -> DataFrame:
    rows = _items(spark, sf_dir).select(F.expr(doc).alias("doc_index"), F.expr(page).alias("page_index"), "item_idx", "label", "bbox", F.concat(F.lit("x"), "part").alias("latex"), F.concat(F.lit("line "), "part").alias("text"))
    none = rows.limit(0)
    tables, seals = none.select(*stages.KEY, F.lit("").alias("html")), none.select(*stages.KEY, "bbox", F.array(F.lit("")).alias("seal_texts"))
    return stages.page_blocks(rows, rows.where("label = 'ocr_text'").select(*stages.PAGE, "label", "bbox", "text"), tables, seals)


@query(f"""WITH i AS ({_ITEMS_SQL}), b AS (SELECT page // 7 AS doc_index, page % 7 AS page_index, y0, x0, label, x1, y1, CASE WHEN label = 'ocr_text' THEN 'line ' || part ELSE 'x' || part END AS content FROM i WHERE label IS NOT NULL),
    m AS (SELECT *, CASE label WHEN 'inline_formula' THEN '$' || content || '$' WHEN 'display_formula' THEN '$$' || chr(10) || content || chr(10) || '$$' ELSE content END AS mark FROM b),
    g AS (SELECT doc_index, string_agg(mark, chr(10) || chr(10) ORDER BY page_index, y0, x0, label, x1, y1, content) AS markdown, string_agg(page_index || ':' || label, ',' ORDER BY page_index, y0, x0, label, x1, y1, content) AS listed FROM m GROUP BY doc_index)
    SELECT DISTINCT o_orderkey // 7 AS doc_index, coalesce(markdown, '') AS markdown, coalesce(listed, '') AS listed FROM orders LEFT JOIN g ON doc_index = o_orderkey // 7""")
def assembled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's Markdown and content list of documents of seven pages."""
    docs = _table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 7").alias("doc_index")).distinct()
    docs = docs.select("doc_index", F.concat(F.lit("doc-"), "doc_index").alias("path"), F.lit("doc").alias("name"))
    blocks = _blocks(spark, sf_dir, "page div 7", "page % 7").withColumns({"w": F.lit(640), "h": F.lit(640)})
    made = Engine(spark).assemble(docs, blocks)
    listed = F.from_json("content_list", "array<struct<type:string,page_idx:long>>")
    return made.select("doc_index", "markdown", F.array_join(F.transform(listed, lambda b: F.concat_ws(":", b["page_idx"], b["type"])), ",").alias("listed"))


@query(f"""WITH i AS ({_ITEMS_SQL}), b AS (SELECT page, y0, x0, label, coalesce(CASE WHEN label = 'ocr_text' THEN 'line ' || part ELSE 'x' || part END, '') AS content, x1, y1 FROM i WHERE label IS NOT NULL)
    SELECT page AS doc_index, string_agg(label || '=' || content, '|' ORDER BY y0, x0, label, x1, y1, content) AS blocks FROM b GROUP BY page""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all kinds as one list a page, in order of their boxes."""
    blocks = _blocks(spark, sf_dir, "page", "0")
    return blocks.select("doc_index", F.array_join(F.transform("blocks", lambda b: F.concat_ws("=", b["label"], b["content"])), "|").alias("blocks"))
