"""URL filters: host and path rules, then a ratio of two character language models.

Rules decide first; of several that fit, the longest. For all other URLs, two variable-order Markov
models over characters, one of accepted and one of rejected URLs, give the difference of their log
likelihoods per character; a URL is blocked if that is above a threshold. All URLs that a rule accepts or
rejects are counted, in two halves by hash, and no others; for the threshold, each is scored by the models
of the other half. It is the one that tells the rejected from the accepted best, of those with at most
`FALSE_BLOCKS` of the accepted above it: how many of the URLs without a rule it blocks is left open. What
judges is the sum of both halves.

A model interpolates orders 0 to ORDER: p_k = (count(context, character) + D p_{k-1}) /
(count(context) + D). Grams and contexts are counted exactly, each order by itself: six characters and
the order fit into one 64-bit key. Tasks send one row per batch and key, summed by key in a table on the
shared folder. The TABLE_KEYS most frequent of these keys, or all if there are no more, go to the tasks. The
rest stays in the folder, and all of it takes part: texts are stored in blocks, each block asks for its keys
that aren't in the table and that a filter lets through, they meet the rest by an exact join, and the block
is scored with what was found. The bound is one of what is sent, and no score depends on it.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule, and is
allowed; ids may be null or repeated; without accepted or without rejected URLs the models allow all
that no rule blocks, and unlabelled ones teach nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import TABLE_KEYS, KeyTable, frequent, in_filter, key_filter, shared_dir, stored, text_batches, utf8

ORDER, D = 5, 2.0
#: The most that may be blocked of accepted URLs that weren't counted; where the scores lie apart, none is.
FALSE_BLOCKS = 0.05
#: Bins a nat for the calibration, which spans -LIMIT to LIMIT nats a character.
FINE, LIMIT = 1000, 8
#: Text of a block that asks for keys the table lacks: at most twelve a byte come back to it.
BLOCK_BYTES = 1 << 18

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rest(url: Column) -> Column:
    """What follows the first `://`; empty for null or if there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest(url), "^[^/?#]*([^?#]*)", 1)


class _Rules:
    """Rules by host; a lookup tries a host and what follows each of its dots."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.by_host: dict[str, list[Rule]] = {}
        for rule in sorted(rules, key=lambda r: (-len(r.text), r.verdict, r.text)):
            self.by_host.setdefault(rule.host, []).append(rule)

    def find(self, host: str, path: str) -> Rule | None:
        best, at = None, 0
        while True:
            for rule in self.by_host.get(host[at:], ()):
                if path.startswith(rule.path):
                    if best is None or len(rule.text) > len(best.text):
                        best = rule
                    break
            at = host.find(".", at) + 1
            if not at:
                return best


def ruled(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, url, host, path, rule and verdict (null where no rule fits)."""
    known = _Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [known.find(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            names = [r and r.text for r in found], [r and r.verdict for r in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.string()) for x in names)], [*batch.schema.names, "rule", "verdict"])

    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    kind = parts.schema["id"].dataType.simpleString()
    return parts.mapInArrow(run, f"id {kind}, url string, host string, path string, rule string, verdict string")


def _keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The text of each character, and for each order its keys of (context, character), context.
    Each text is led by ORDER marks, and its end is a character of its own. Bits 48 to 55 are free."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    at = offsets + np.arange(n + 1) * (ORDER + 1)
    text = np.repeat(np.arange(n), lengths)
    padded = np.full(at[-1], 2, np.uint64)
    padded[np.arange(len(data)) + (text + 1) * (ORDER + 1) - 1] = data
    padded[at[1:] - 1] = 3
    own = np.repeat(np.arange(n), lengths + 1)
    places = np.arange(len(own)) + (own + 1) * ORDER

    def orders() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        context, character = np.zeros(len(own), np.uint64), padded[places]
        for k in range(ORDER + 1):
            if k:
                context = context | (padded[places - k] << np.uint64(8 * k))
            mark = np.uint64((k + 1) << 56)
            yield context | character | mark, context | mark | np.uint64(1 << 63)

    return own, orders()


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(batch.column("text"))
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64), offsets


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, "text"):
        own, orders = _keys(*_texts(batch))
        rejected, odd = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.uint64)[own] for c in ("rejected", "odd"))
        kind = (2 * odd + rejected) << np.uint64(48)
        for pair in orders:
            for keys in pair:
                used, n = np.unique(keys | kind, return_counts=True)
                kinds = (used >> np.uint64(48)) & np.uint64(3)
                yield pa.RecordBatch.from_pydict({"key": (used & ~np.uint64(3 << 48)).view(np.int64), "kind": kinds.astype(np.int32), "n": n.astype(np.int64)})


def _counts_of(keys: np.ndarray, table: KeyTable, more: KeyTable | None) -> np.ndarray:
    """The counts of each key; of those that `table` lacks, the ones in `more`."""
    row = table.find(keys)
    n = table.values[row]
    if more is not None:
        rare = np.flatnonzero(row < 0)
        n[rare] = more.values[more.find(keys[rare])]
    return n


def _difference(batch: pa.RecordBatch, table: KeyTable, more: KeyTable | None, half: np.ndarray | None = None) -> np.ndarray:
    """log p_rejected - log p_accepted per character of each text, its end included; by all counts, or
    by those of one half for each text."""
    own, orders = _keys(*_texts(batch))
    p = np.full((2, len(own)), 1 / 256)
    for pair in orders:
        gram, context = (_counts_of(keys, table, more) for keys in pair)
        for which in (0, 1):
            seen, of = (n[:, which] + n[:, 2 + which] if half is None else np.where(half[own], n[:, 2 + which], n[:, which]) for n in (gram, context))
            p[which] = (seen + D * p[which]) / (of + D)
    n = batch.num_rows
    return np.bincount(own, np.log(p[1]) - np.log(p[0]), minlength=n) / np.bincount(own, minlength=n)


def _table(rows: pa.Table) -> KeyTable:
    return KeyTable(rows["key"].to_numpy().view(np.uint64), np.stack([rows[f"n{k}"].to_numpy() for k in range(4)], axis=1))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    for batch in text_batches(batches, "text", BLOCK_BYTES):
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, block))], [*batch.schema.names, "block"])
        block += 1


def _scored(rows: DataFrame, table: KeyTable, rare: DataFrame | None, run: Callable[[pa.RecordBatch, KeyTable, KeyTable | None], pa.RecordBatch], kind: str) -> DataFrame:
    """`run` over batches of `rows`, with `table` and, if there are `rare` keys, a table of those of the batch."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    if rare is None:

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_batches(batches, "text"):
                yield run(batch, shared.value, None)

        return rows.mapInArrow(narrow, kind)

    # stored, so that a block has the same rows each time it is read
    blocks = stored(rows.mapInArrow(_numbered, StructType([*rows.schema.fields]).add("block", LongType())), f"{shared_dir(rows.sparkSession)}/blocks")
    packed = rows.sparkSession.sparkContext.broadcast(key_filter(rare.select("key")))

    def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for at, upto in zip(cuts, cuts[1:]):
                if at == upto:
                    continue
                _, orders = _keys(*_texts(batch.slice(at, upto - at)))
                for pair in orders:
                    for keys in pair:
                        asked = np.unique(keys[shared.value.find(keys) < 0])
                        asked = asked[in_filter(packed.value, asked)]
                        yield pa.RecordBatch.from_pydict({"block": np.full(len(asked), block[at]), "key": asked.view(np.int64)})

    def wide(own: pa.Table, found: pa.Table) -> pa.Table:
        more = _table(found)
        return pa.Table.from_batches([run(batch, shared.value, more) for batch in own.combine_chunks().to_batches()])

    found = blocks.select("text", "block").mapInArrow(lacking, "block long, key long").join(rare.hint("merge"), "key")
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(wide, kind)


class Model(NamedTuple):
    table: KeyTable  # by half: accepted, rejected; of the most frequent keys
    threshold: float
    #: Shares of rejected and of accepted URLs above the threshold, each scored by the half it isn't in.
    caught: float
    false_blocks: float
    #: key, n0 to n3 of all keys that the table lacks, on the shared folder; None if there are none.
    rare: DataFrame | None = None


def fit(urls: DataFrame, false_blocks: float = FALSE_BLOCKS, most: int = TABLE_KEYS, folder: str | None = None) -> Model:
    """Models and threshold from `urls` (columns url and rejected, null for URLs that aren't labelled)."""
    folder = folder or shared_dir(urls.sparkSession)
    text = rest(F.col("url"))
    texts = urls.where("rejected is not null").select(text.alias("text"), "rejected", (F.pmod(F.xxhash64(text), F.lit(2)) == 1).alias("odd")).where("text != ''")
    kinds = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).cast("float").alias(f"n{k}") for k in range(4)]
    counts = stored(texts.mapInArrow(_count, "key long, kind int, n long").groupBy("key").agg(*kinds), f"{folder}/grams")
    n = [F.col(f"n{k}") for k in range(4)]
    known = frequent(counts, n[0] + n[1] + n[2] + n[3], most)
    table = _table(counts.where(known).toArrow())
    others = counts.where(~known)
    rare = others if others.take(1) else None
    if not all(counts.agg(F.max(n[0] + n[2]), F.max(n[1] + n[3])).first()):
        return Model(table, np.inf, 0.0, 0.0, rare)

    def bins(batch: pa.RecordBatch, table: KeyTable, more: KeyTable | None) -> pa.RecordBatch:
        score = _difference(batch, table, more, ~batch.column("odd").to_numpy(zero_copy_only=False).astype(bool))
        return pa.RecordBatch.from_pydict({"bin": pa.array(np.ceil(np.clip(score, -LIMIT, LIMIT) * FINE), pa.int32()), "rejected": batch.column("rejected")})

    # a key that one half alone has is in no text that is scored by that half
    both = None if rare is None else others.where((n[0] + n[1] > 0) & (n[2] + n[3] > 0))
    held = _scored(texts, table, both, bins, "bin int, rejected boolean").groupBy("bin", "rejected").count().toPandas()
    counts = np.zeros((2, 2 * LIMIT * FINE + 1))
    np.add.at(counts, (held.rejected.astype(int), held.bin + LIMIT * FINE), held["count"])
    at = cut(*counts, false_blocks)
    wrong, right = (n[at + 1 :].sum() / n.sum() for n in counts)
    return Model(table, at / FINE - LIMIT, float(right), float(wrong), rare)


def cut(accepted: np.ndarray, rejected: np.ndarray, false_blocks: float) -> int:
    """The bin above which the share of the rejected exceeds that of the accepted most, with at most
    `false_blocks` of the accepted; the middle one, if several bins in a row are as good."""
    good, bad = (1 - np.cumsum(n) / n.sum() for n in (accepted, rejected))
    gain = np.where(good <= false_blocks + 1e-12, np.round(bad - good, 12), -np.inf)
    best = np.flatnonzero(gain == gain.max())
    run = max(np.split(best, np.flatnonzero(np.diff(best) > 1) + 1), key=len)
    return int(run[len(run) // 2])


def judge(pages: DataFrame, rules: Sequence[Rule], model: Model | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict and score of each page; the model, if none is given, is
    fitted to the pages: those a rule blocks are rejected, those a rule allows accepted."""
    known = ruled(pages, rules, id_col, url_col)
    if model is None:
        model = fit(known.select("url", (F.col("verdict") == "block").alias("rejected")))
    threshold = model.threshold

    def run(batch: pa.RecordBatch, table: KeyTable, more: KeyTable | None) -> pa.RecordBatch:
        score = _difference(batch, table, more)
        empty = np.diff(utf8(batch.column("text"))[1]) == 0
        score[empty] = 0
        method = np.where((score > threshold) & ~empty, "block", "allow")
        verdict = [r or m for r, m in zip(batch.column("verdict").to_pylist(), method.tolist())]
        names = ["id", "host", "path", "rule"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(verdict, pa.string()), pa.array(score)], [*names, "verdict", "score"])

    kind = known.schema["id"].dataType.simpleString()
    rows = known.select("id", rest(F.col("url")).alias("text"), "host", "path", "rule", "verdict")
    return _scored(rows, model.table, model.rare, run, f"id {kind}, host string, path string, rule string, verdict string, score double").withColumnRenamed("id", id_col)
