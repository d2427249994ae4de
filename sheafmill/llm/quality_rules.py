"""Quality rules: word and line rules, then an n-gram log-likelihood ratio.

Two multinomials over byte 4-grams are counted: one over every document (raw), one over every trusted
document (target). A document's score is the sum over its 4-grams of log p_target - log p_raw, divided by
their number plus `PRIOR`. Both sides are smoothed in proportion to their size, so that a gram that was
hardly seen says little. A document is kept if no base rule fails and its score reaches a threshold that
at most `FALSE_REJECTS` of the trusted documents are below, each scored without its own counts in the
target.

Grams are counted by key in a table on the shared folder that grows with the corpus. The most frequent
TABLE_KEYS of them go to the tasks as they are; should there be more, the rest is hashed to POOL buckets,
which go along, so that every gram is counted and what is sent has a bound. Counting all documents and
judging are narrow. Trusted ids go to the documents if they are few enough by count; more of them
meet the documents by shuffle, behind a filter.

Defined results: null and empty texts have zero in every count and fail the base rule of ten
words; a null id stays null; repeated rows are judged alike, each by itself; an empty table gives
an empty result; without trusted documents the ratio is 0 and the base rules alone decide.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, TABLE_KEYS, KeyTable, frequent, key_filter, may_be_in, mix64, random64, shared_dir, stored, text_batches, utf8
from .words import Words, span_hashes

GRAM = 4
#: The key where a 4-gram would leave its text.
NO_GRAM = 1 << 32
#: Grams of ratio 0 that every document is given, so that a few words can't condemn it.
PRIOR = 32
FALSE_REJECTS = 0.005
#: Bins a nat for the threshold, which spans -LIMIT to LIMIT nats a gram.
FINE, LIMIT = 1000, 16
#: Buckets that rare grams share.
POOL = 1 << 16
#: Rows of counts that a task holds before it merges them.
HELD = 1 << 20
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

DIGEST = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FIVE = random64(5, 21)


def gram_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 4-gram at each byte; NO_GRAM where it would leave its text."""
    out = np.empty(len(data), np.uint64)
    for shift in range(GRAM):
        whole = (len(data) - shift) // GRAM
        if whole > 0:
            out[shift : shift + whole * GRAM : GRAM] = np.frombuffer(data[shift : shift + whole * GRAM].tobytes(), "<u4")
    for back in range(1, GRAM):
        at = offsets[1:] - back
        out[at[at >= offsets[:-1]]] = NO_GRAM
    return out


def _sums(mask: np.ndarray, offsets: np.ndarray, kind: type = np.int64) -> np.ndarray:
    total = np.zeros(len(mask) + 1, kind)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, whether another equals it, and whether it comes first in a sorted order."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    any_twin, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_twin[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return any_twin, later


def base_columns(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text, as numpy arrays."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    salt = random64(n, 22)

    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.starts] += 1
    np.subtract.at(inside, words.ends, 1)
    in_word = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    word_chars = _sums(in_word & ((data & 0xC0) != 0x80), offsets)

    cut = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], cut + 1]))
    ends = np.sort(np.concatenate([cut, offsets[1:]]))
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[filled], ends[filled]
    text = np.searchsorted(offsets, starts, side="right") - 1
    _, later = _repeated(mix64(span_hashes(data, starts, ends) ^ salt[text]))
    dup_lines = np.bincount(text[later], minlength=n)

    hashes = words.hashes()
    repeat = np.zeros(n, np.int64)
    if len(hashes) >= 5:
        key = sum(hashes[k : len(hashes) - 4 + k] * _FIVE[k] for k in range(5))
        owner = np.repeat(np.arange(n), words.counts)
        whole = np.flatnonzero(owner[: len(key)] == owner[4:])
        twin, _ = _repeated(mix64(mix64(key[whole]) ^ salt[owner[whole]]))
        covered = np.zeros(len(hashes), bool)
        for k in range(5):
            covered[whole[twin] + k] = True
        repeat = _sums(covered, words.bounds)
    return {"n_words": words.counts.astype(np.int64), "word_chars": word_chars, "n_symbols": _sums(_SYMBOL[data], offsets), "n_dup_lines": dup_lines.astype(np.int64), "n_repeat_words": repeat}


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, n = (np.concatenate(x) for x in zip(*held))
    used, which = np.unique(grams, return_inverse=True)
    return used, np.bincount(which, n, minlength=len(used)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = least = 0
    for batch in text_batches(batches, "text"):
        grams = gram_keys(*utf8(batch.column("text")))
        held.append(np.unique(grams[grams != NO_GRAM].astype(np.uint32), return_counts=True))
        rows += len(held[-1][0])
        if rows > least + HELD:
            held = [_merged(held)]
            rows = least = len(held[0][0])
    if rows:
        grams, n = _merged(held)
        yield pa.RecordBatch.from_pydict({"gram": grams.astype(np.int64), "n": n})


class Model(NamedTuple):
    table: KeyTable  # the log ratio of each gram
    threshold: float


def _chosen(rows: DataFrame, trusted: DataFrame, folder: str) -> DataFrame:
    """The texts of rows whose id is in the one column of `trusted`, none left out."""
    ids = trusted.select(F.col(trusted.columns[0]).cast(rows.schema["id"].dataType).alias("id")).where("id is not null").distinct()
    if ids.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(ids), "id", "left_semi").select("text")
    maybe = may_be_in(key_filter(ids.select(F.xxhash64("id"))), F.xxhash64("id"), rows.sparkSession)
    return stored(rows.where(maybe).join(ids.hint("merge"), "id", "left_semi").select("text"), f"{folder}/trusted")


def _without_own(batch: pa.RecordBatch, table: KeyTable, raw: float, target: float) -> np.ndarray:
    """The scores of trusted texts, each without its own grams in the target."""
    data, offsets = utf8(batch.column("text"))
    grams = gram_keys(data, offsets)
    inside = grams != NO_GRAM
    text = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(offsets))
    used, own = np.unique((text << np.uint64(32) | grams)[inside], return_counts=True)
    text = (used >> np.uint64(32)).astype(np.int64)
    counts = table.values[table.find(used & np.uint64(0xFFFFFFFF))]
    n = np.bincount(text, own, minlength=batch.num_rows)
    ratio = np.log((counts[:, 1] - own + 1) / (counts[:, 0] * ((target - n) / raw)[text] + 1))
    return np.bincount(text, own * ratio, minlength=batch.num_rows) / (n + PRIOR)


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, POOL))
    for batch in batches:
        bucket = KeyTable.pool_of(batch.column("gram").to_numpy(), POOL)
        for total, c in zip(sums, ("raw", "target")):
            total += np.bincount(bucket, batch.column(c).to_numpy(), minlength=POOL)
    at = np.flatnonzero(sums[0] + sums[1])
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "raw": pa.array(sums[0, at]), "target": pa.array(sums[1, at])})


def _table(counts: DataFrame, most: int) -> KeyTable:
    """raw and target of each gram; beyond `most` of them, of rare ones by bucket."""
    known = frequent(counts, F.col("raw") + F.col("target"), most)
    rows = counts.where(known).toArrow()
    keys = np.append(rows["gram"].to_numpy().astype(np.uint64), np.uint64(NO_GRAM))
    values = np.stack([np.append(rows[c].to_numpy(), 0) for c in ("raw", "target")], axis=1).astype(np.float64)
    rest = counts.where(~known)
    if not rest.take(1):
        return KeyTable(keys, values)
    sums = rest.mapInArrow(_pooled, "bucket int, raw double, target double").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    pool = np.zeros((POOL, 2))
    pool[sums["bucket"].to_numpy()] = np.stack([sums["raw"].to_numpy(), sums["target"].to_numpy()], axis=1)
    return KeyTable(keys, values, pool)


def fit(docs: DataFrame, trusted: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", false_rejects: float = FALSE_REJECTS, most: int = TABLE_KEYS, folder: str | None = None) -> Model:
    """The log ratio of each gram, from all of `docs` and from all of those whose id is in `trusted`
    (a DataFrame of one column of ids), and the threshold."""
    folder = folder or shared_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    none = F.lit(0).cast("long")
    counts = rows.select("text").mapInArrow(_count, "gram long, n long").select("gram", F.col("n").alias("raw"), none.alias("target"))
    chosen = None
    if trusted is not None:
        chosen = _chosen(rows, trusted, folder)
        counts = counts.union(chosen.mapInArrow(_count, "gram long, n long").select("gram", none, "n"))
    counts = stored(counts.groupBy("gram").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")), f"{folder}/grams")
    table = _table(counts, most)
    raw, target = table.values.sum(axis=0)
    ratio = copy.copy(table)
    if not target:
        ratio.values = np.zeros(len(table.values))
        return Model(ratio, -np.inf)
    ratio.values = np.log((table.values[:, 1] + 1) / (table.values[:, 0] * (target / raw) + 1))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            score = _without_own(batch, shared.value, raw, target)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(np.floor(np.clip(score, -LIMIT, LIMIT) * FINE), pa.int32())})

    held = chosen.where("text != ''").mapInArrow(bins, "bin int").groupBy("bin").count().toPandas().sort_values("bin")
    below = held["count"].cumsum() - held["count"]
    return Model(ratio, float(held.bin[below <= false_rejects * held["count"].sum()].max()) / FINE)


def _judge(batch: pa.RecordBatch, column: str, model: Model) -> dict[str, np.ndarray]:
    data, offsets = utf8(batch.column(column))
    base = base_columns(data, offsets)
    failed = base_failed(base)
    total = _sums(model.table.values[model.table.find(gram_keys(data, offsets))], offsets, np.float64)
    score = total / (np.maximum(np.diff(offsets) - GRAM + 1, 0) + PRIOR)
    return base | {"base_failed": failed, "kept": ~failed & (score >= model.threshold), "score": score}


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the columns of DIGEST for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), **_judge(batch, "text", shared.value)})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {DIGEST}").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, text_col):
            yield batch.filter(pa.array(_judge(batch, text_col, shared.value)["kept"]))

    return docs.mapInArrow(run, docs.schema)
