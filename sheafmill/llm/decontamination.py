"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item's set is its distinct three-word shingles, A-Z lower-cased. Of each item the SAMPLES shingles
with the smallest hashes are its MinHash sample; a text that contains the share c of an item holds the
share c of its sample, however long the text is. Items are partitioned by size, a power of two each;
a partition has its own number of sample shingles that a text must hold, the largest that misses an
item at the limit with a probability below MISS, and texts too short for it are passed over. Every
shingle of every text is looked up: a bitmap of fixed size with the sampled hashes drops nearly all
where they are read, and the rest meets the samples in a join, so that benchmarks may be of any size.
Candidates are verified on the full sets: an item leaks if 100 * shared >= LEAST * size of its set.

Equal texts are one text until the end, so that copies are verified once.

An item of one or two words is its whole sequence, and a text holds it where these words stand side by
side; such items have lookups of their own, made only if there are any. As they are common in clean texts,
`cleaned` lets them cost no document unless told so.

Defined results: null and empty texts contain nothing, and null and empty items are not found; ids, of
items too, may be null or repeated and come back as they are, every row by itself; empty tables give
an empty result; texts of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_filter, key_filter, may_be_in, mix64, shared_dir, stored, text_batches, utf8, without
from .words import Words, shingles

SAMPLES, MISS = 16, 1e-9
LEAST = 70
SHINGLE = 3


def text_keys(text: Column) -> dict[str, Column]:
    """128 bits that identify a text."""
    known = F.coalesce(text, F.lit(""))
    return {"key_a": F.xxhash64(known), "key_b": F.xxhash64(F.lit(1), known)}


def _shingles(batch: pa.RecordBatch, name: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles of `size` words in text order, and bounds by text."""
    words = Words(*utf8(batch.column(name)))
    return shingles(words, words.hashes(lower=True), size)


def needed(size: int) -> int:
    """Sample shingles that a text must hold of an item of `size` shingles."""
    take, there = min(SAMPLES, size), ceil(LEAST * size / 100)
    total, below = comb(size, take), 0
    for hits in range(take + 1):
        below += comb(there, hits) * comb(size - there, take - hits)
        if below > MISS * total:
            return max(hits, 1)
    return take


@lru_cache(maxsize=64)
def needed_by_partition(partition: int) -> int:
    """The least of `needed` over sizes of 2**partition to twice that."""
    low = 1 << partition
    return min(needed(low + low * step // 16) for step in range(16))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, "text"):
        counts = np.minimum(Words(*utf8(batch.column("text"))).counts, SHINGLE)
        rows: list[list] = [[], [], [], [], []]
        for words in range(1, SHINGLE + 1):
            hashes, bounds = _shingles(batch, "text", words)
            for k in np.flatnonzero(counts == words):
                own = np.unique(hashes[bounds[k] : bounds[k + 1]])
                for value in own[np.argsort(mix64(own), kind="stable")[:SAMPLES]].view(np.int64).tolist():
                    for column, x in zip(rows, (k, value, words, len(own), needed_by_partition(len(own).bit_length() - 1))):
                        column.append(x)
        at = pa.array(rows[0], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("item_a").take(at), batch.column("item_b").take(at), *(pa.array(x, pa.int64()) for x in rows[1:])], ["item_a", "item_b", "hash", "words", "item_size", "need"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_batches(iter([whole]), "text"):
            counts = np.minimum(Words(*utf8(batch.column("item"))).counts, SHINGLE)
            shared, size = np.zeros((2, batch.num_rows), np.int64)
            for words in np.unique(counts[counts > 0]).tolist():
                sides = [_shingles(batch, c, words) for c in ("text", "item")]
                for k in np.flatnonzero(counts == words):
                    own, item = (np.unique(hashes[bounds[k] : bounds[k + 1]]) for hashes, bounds in sides)
                    size[k] = len(item)
                    shared[k] = np.isin(item, own, assume_unique=True).sum()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key_a", "key_b", "item_a", "item_b")), pa.array(shared), pa.array(size)], ["key_a", "key_b", "item_a", "item_b", "n_shared", "item_size"])


def leaks(texts: DataFrame, items: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """From `texts` (id, text) and `items` (item_a, item_b, text): key_a, key_b, item_a, item_b, n_shared
    and item_size of each text and item that it holds; and id, key_a and key_b of all rows that met any
    sample."""
    spark = texts.sparkSession
    samples = stored(items.mapInArrow(_sampled, "item_a long, item_b long, hash long, words long, item_size long, need long"), f"{folder}/samples")
    wanted = spark.sparkContext.broadcast(key_filter(samples.select("hash")))
    lengths = sorted(r.words for r in samples.select("words").distinct().collect())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            for words in lengths:
                hashes, bounds = _shingles(batch, "text", words)
                hit = np.flatnonzero(in_filter(wanted.value, hashes))
                own = pa.array(np.searchsorted(bounds, hit, side="right") - 1)
                size = pa.array(np.diff(bounds)).take(own)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in ("id", "key_a", "key_b")), size, pa.array(hashes[hit].view(np.int64))], ["id", "key_a", "key_b", "size", "hash"])

    keyed = texts.withColumns(text_keys(F.col("text")))
    kind = texts.schema["id"].dataType.simpleString()
    met = stored(keyed.mapInArrow(meet, f"id {kind}, key_a long, key_b long, size long, hash long"), f"{folder}/met")
    # the size of a text counts repeated shingles, so it is no less than that of its set
    hits = met.select("key_a", "key_b", "size", "hash").distinct().join(samples, "hash").where(f"100 * size >= {LEAST} * item_size")
    pair = ["key_a", "key_b", "item_a", "item_b"]
    pairs = stored(hits.groupBy(*pair).agg(F.count("*").alias("hits"), F.max("need").alias("need")).where("hits >= need").select(pair), f"{folder}/pairs")

    near = keyed.where(may_be_in(key_filter(pairs.select("key_a")), F.col("key_a"), spark)).select("key_a", "key_b", "text")
    near = near.join(pairs.select("key_a", "key_b").distinct(), ["key_a", "key_b"], "left_semi").dropDuplicates(["key_a", "key_b"])
    both = pairs.join(near, ["key_a", "key_b"]).join(items.withColumnRenamed("text", "item"), ["item_a", "item_b"]).select(*pair, "text", "item")
    shared = both.mapInArrow(_shared, "key_a long, key_b long, item_a long, item_b long, n_shared long, item_size long")
    return stored(shared.where(f"100 * n_shared >= {LEAST} * item_size"), f"{folder}/leaks"), met.select("id", "key_a", "key_b").distinct()


def _items(benchmark: DataFrame, text_col: str) -> DataFrame:
    keys = text_keys(F.col(text_col))
    made = benchmark.where(F.col(text_col).isNotNull()).select(keys["key_a"].alias("item_a"), keys["key_b"].alias("item_b"), F.col(text_col).alias("text"))
    return made.dropDuplicates(["item_a", "item_b"])


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", folder: str | None = None) -> DataFrame:
    """id_col, item_col, n_shared, item_size and containment of each document and each benchmark item
    that leaks into it. Rows of one id and one text are one document."""
    folder = folder or shared_dir(docs.sparkSession)
    found, rows = leaks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), _items(benchmark, item_text_col), folder)
    keys = text_keys(F.col(item_text_col))
    names = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("item"), keys["key_a"].alias("item_a"), keys["key_b"].alias("item_b")).distinct()
    joined = rows.join(found, ["key_a", "key_b"]).join(names, ["item_a", "item_b"])
    return joined.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_shared", "item_size", (F.col("n_shared") / F.col("item_size")).alias("containment"))


def cleaned(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", folder: str | None = None, min_words: int = SHINGLE) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text holds no benchmark item of `min_words` words."""
    folder = folder or shared_dir(docs.sparkSession)
    long = F.size(F.regexp_extract_all(F.col(item_text_col), F.lit(r"[^\x20\x09-\x0D]+"), 0)) >= min_words
    found, _ = leaks(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), _items(benchmark.where(long), item_text_col), folder)
    return without(docs, found.select("key_a", "key_b"), text_keys(F.col(text_col)))
