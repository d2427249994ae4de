"""Queries over tables that the given ones don't hold, against their SQL."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from sheafmill.operators import rasters
from sheafmill.plans.catalog import ORACLE_SQL, QUERIES
from sheafmill.sources import files

from .test_oracle import TABLES, plain


def same_as_sql(spark, name, folder, *tables):
    """The rows of a query, which are those of its SQL."""
    duck = duckdb.connect()
    for t in tables:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    rows = QUERIES[name](spark, str(folder)).select(names).collect()
    assert sorted(repr(tuple(map(plain, r))) for r in rows) == sorted(repr(tuple(map(plain, r))) for r in result.fetchall())
    return rows


def documents_of(spark, folder, rows):
    made = [(k, "x" * n, lang, "web", n) for k, (lang, n) in enumerate(rows)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")


#: A whole batch without width and one of both kinds; only empty ones; an empty one before one over the budget.
EMPTY = [*[("en", 0)] * 15, *[("en", 90)] * 9, *[("de", 0)] * 2, ("fr", 0), ("fr", 9000), ("es", 700)]


def test_empty_documents_are_batched(spark, tmp_path):
    documents_of(spark, tmp_path, EMPTY)
    rows = same_as_sql(spark, "adaptive_rec_batches", tmp_path, "documents")
    assert len(rows) == len(EMPTY)


def test_lists_of_empty_documents_are_padded(spark, tmp_path):
    documents_of(spark, tmp_path, EMPTY)
    rows = same_as_sql(spark, "pad_to_bucket", tmp_path, "documents")
    assert sum(r.ids == "" for r in rows) > sum(r.ids == "-1" for r in rows) > 0


def test_empty_documents_are_recognised(spark, tmp_path):
    documents_of(spark, tmp_path, EMPTY)
    rows = same_as_sql(spark, "recognise_lines", tmp_path, "documents")
    assert len(rows) == len(EMPTY)


def test_tables_in_folders_are_scanned_as_one(spark, tmp_path):
    folder = tmp_path / "all.parquet" / "sf"
    for name in sorted(set(TABLES.split()) - {"orders", "pages"}):
        (folder / f"{name}.parquet").parent.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.parquet").write_bytes(b"1")
    for k, part in enumerate(("orders.parquet/part-0.parquet", "orders.parquet/part-1.parquet", "pages.parquet/k=1/part-0.parquet", "pages.parquet/k=2.parquet/part-0.parquet")):
        (folder / part).parent.mkdir(parents=True, exist_ok=True)
        (folder / part).write_bytes(b"22" * (k + 1))
    (folder / "orders.parquet/_SUCCESS").write_bytes(b"")
    assert len(same_as_sql(spark, "document_scan", folder)) == 14
    for target in (str(folder), f"{folder}/", f"file://{folder}"):
        whole = files.in_folders(files.scan(spark, target, pattern="*.parquet"), target, ".parquet").where("length > 1").orderBy("path").collect()
        assert [(r.path, r.name, r.length) for r in whole] == [(f"file:{folder}/orders.parquet", "orders", 6), (f"file:{folder}/pages.parquet", "pages", 14)]


def test_pages_of_many_ranges_leave_as_one_batch():
    ranges = pa.RecordBatch.from_pydict({"path": [f"d{k}" for k in range(3000)], "first": [0] * 3000, "last": [2] * 3000})
    page = lambda path, content, first, last: [(b"1", "c") for _ in range(first, last + 1)]
    made = list(files._rendered(iter([ranges, ranges]), page, None, None, None))
    assert sum(map(len, made)) == 18_000 and len(made) < 6 and pa.Table.from_batches(made).column("path").to_pylist() == [f"d{k}" for _ in range(2) for k in range(3000) for _ in range(3)]
    large = lambda path, content, first, last: [(bytes(1 << 20), None) for _ in range(first, last + 1)]
    sizes = [b.nbytes for b in files._rendered(iter([ranges.slice(0, 40)]), large, None, None, None)]
    assert sum(sizes) > 120 << 20 and max(sizes) < 12 << 20


def test_tensors_leave_in_pieces_of_some_bytes():
    frame = pd.DataFrame({"k": range(50), "n": [k % 4 for k in range(50)]})
    make = lambda row: [rasters.tensor_row(np.full((1, 256, 512), row["k"], np.float32) if row["k"] % 5 else None) for _ in range(row["n"])]
    pieces = list(rasters._in_pieces(frame, make))
    assert [at for at, _ in pieces] == np.cumsum([0, *(len(found) for _, found in pieces)])[:-1].tolist() and sum(len(found) for _, found in pieces) == 50
    assert [len(rows) for _, found in pieces for rows in found] == frame.n.tolist()
    assert max(sum(r["tensor"].nbytes for rows in found for r in rows if r["tensor"] is not None) for _, found in pieces) < rasters.PIECE + (3 << 19) and len(pieces) > 5


def test_pieces_keep_their_images_columns(spark):
    images = spark.range(40).select(F.col("id").alias("k"), F.lit(2).alias("h"), F.lit(3).alias("w"), F.expr("unhex(repeat(lpad(hex(id), 2, '0'), 18))").alias("data"), F.when(F.col("id") % 3 == 0, "n").alias("note"))
    rows = rasters.line_inputs(images, F.lit(4), F.lit(1000), 64).select("k", "note", F.col("tensor")[0].alias("v"), F.size("tensor").alias("n")).collect()
    assert {(r.k, r.note, round((r.v + 1) * 127.5), r.n) for r in rows} == {(k, "n" if k % 3 == 0 else None, k, 3 * 64 * 1000) for k in range(40)} and len(rows) == 40
