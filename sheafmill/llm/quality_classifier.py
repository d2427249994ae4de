"""Quality classifier: a generalised additive model with pairwise interactions.

A text has the features FEATURES, computed from its whole words, lines and bytes. Each feature is cut
into at most BINS bins at quantiles and even steps of the training rows. Boosting goes round the features in turn, a
shallow tree of one feature at a time on the current gradient, and adds its leaves to the feature's
lookup table; then round the PAIRS pairs of features with the strongest remaining interaction, on
coarser bins, in the same way. A score is the logistic of a sum of table entries.

The model is fitted on at most TRAIN_ROWS labelled rows, those with the smallest hashes of their id,
and no row of the held-out fold; features are computed for all rows, in one pass over the texts, and
scores are sums of entries picked by bin, vectorised over whole batches.

Defined results: null and empty texts have feature values of their own (all 0) and a score like any
other text; ids may be null (never held out, never learnt from) or repeated, every row by itself; without
labelled rows every score is 0.5, with labels of one kind alone the scores lean to that kind; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, random64, shared_dir, stored, text_batches, utf8
from .quality_rules import base_columns
from .words import Words

TRAIN_ROWS = 20_000
BINS, COARSE, PAIRS, ROUNDS, PAIR_ROUNDS = 48, 12, 10, 120, 40
RATE, LEAVES, LEAF_WEIGHT, SHRINK = 0.15, 4, 8.0, 1.0
FOLDS, THRESHOLD = 5, 0.3

_CLASSES = {
    "upper_share": range(65, 91), "digit_share": range(48, 58), "symbol_share": b"#*$%&|<>", "shout_share": b"!?", "stop_share": b".,;:",
    "bracket_share": b"()[]{}/\\_=+~^`@", "quote_share": b"\"'-", "blank_share": b" \t\r", "line_share": b"\n",
}
FEATURES = (
    "log_words", "word_length", "word_spread", "longest_word", "words_a_line", "repeat_share", "dup_line_share", "variety", "top_word_share",
    "neighbour_share", "capital_share", "odd_end_share", "entropy", "multibyte_share", *_CLASSES,
)
_IN_CLASS = np.zeros((len(_CLASSES), 256))
for _k, _members in enumerate(_CLASSES.values()):
    _IN_CLASS[_k, list(_members)] = 1
_ORDINARY_END = np.zeros(256, bool)
_ORDINARY_END[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b".,;:!?"]] = True
_SALT = random64(1, 51)[0]


def held_out(id_: Column) -> Column:
    """Whether a row is in the held-out fold, by the CRC-32 of its id as text; false for a null id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


# -- features ----------------------------------------------------------------------------------


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES of each text, a row each."""
    n = len(offsets) - 1
    base = base_columns(data, offsets)
    words = Words(data, offsets)
    count, size = words.counts, np.maximum(np.diff(offsets), 1)
    per_word = np.maximum(count, 1)
    owner = np.repeat(np.arange(n), count)
    length = (words.ends - words.starts).astype(float)
    out = dict.fromkeys(FEATURES, np.zeros(n))
    out["log_words"] = np.log1p(count)
    out["word_length"] = base["word_chars"] / per_word
    mean = np.bincount(owner, length, minlength=n) / per_word
    out["word_spread"] = np.sqrt(np.maximum(np.bincount(owner, length**2, minlength=n) / per_word - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    out["longest_word"] = np.log1p(longest)
    owner_byte = np.repeat(np.arange(n), np.diff(offsets))
    histogram = np.bincount(owner_byte * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    lines = histogram[:, 10] + 1
    out["words_a_line"] = np.log1p(count / lines)
    out["repeat_share"] = base["n_repeat_words"] / per_word
    out["dup_line_share"] = base["n_dup_lines"] / lines
    hashes = words.hashes(lower=True)
    # equal words of one text are runs of equal keys; a run's text is that of its first word
    key = mix64(hashes ^ (_SALT * (owner.astype(np.uint64) + np.uint64(1))))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    run = np.diff(np.concatenate([first, [len(key)]]))
    text = owner[order[first]]
    # a vocabulary grows like the square root of a text
    out["variety"] = np.bincount(text, minlength=n) / np.sqrt(per_word)
    top = np.zeros(n)
    np.maximum.at(top, text, run)
    out["top_word_share"] = top / per_word
    if len(hashes) > 1:
        same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        out["neighbour_share"] = np.bincount(owner[1:][same], minlength=n) / per_word
    if len(hashes):
        upper = (data[words.starts] >= 65) & (data[words.starts] <= 90)
        out["capital_share"] = np.bincount(owner[upper], minlength=n) / per_word
        odd = ~_ORDINARY_END[data[words.ends - 1]]
        out["odd_end_share"] = np.bincount(owner[odd], minlength=n) / per_word
    p = histogram / size[:, None]
    out["entropy"] = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    out["multibyte_share"] = histogram[:, 192:].sum(axis=1) / size
    shares = histogram @ _IN_CLASS.T / size[:, None]
    for k, name in enumerate(_CLASSES):
        out[name] = shares[:, k]
    table = np.stack([out[name] for name in FEATURES], axis=1)
    table[np.diff(offsets) == 0] = 0
    return table


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, "text"):
        table = features(*utf8(batch.column("text"))).astype(np.float32)
        offsets = pa.array(np.arange(0, table.size + 1, len(FEATURES)), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(table.ravel()))], ["id", "features"])


def measured(docs: DataFrame) -> DataFrame:
    """id and features of each row (id, text)."""
    return docs.mapInArrow(_measured, f"id {docs.schema['id'].dataType.simpleString()}, features array<float>")


# -- the model ---------------------------------------------------------------------------------


class Model(NamedTuple):
    intercept: float
    #: Upper ends of all bins but the last, and the table of each feature.
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    #: Pairs of features, the upper ends of their coarse bins and their tables.
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.intercept)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, rows[:, k], side="left")]
        if self.pairs:
            bins = [np.searchsorted(cuts, rows[:, k], side="left") for k, cuts in enumerate(self.coarse)]
            for (a, b), table in zip(self.pairs, self.pair_tables):
                total += table[bins[a], bins[b]]
        return 1 / (1 + np.exp(-total))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Upper ends of bins: quantiles, and as many even steps again, as rare values lie far apart."""
    if not len(values):
        return np.zeros(0, np.float32)
    half = np.linspace(0, 1, bins // 2 + 1)[1:-1]
    even = values.min() + (values.max() - values.min()) * half
    return np.unique(np.concatenate([np.quantile(values, half), even]).astype(np.float32))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins; -inf where none leaves enough on both sides."""
    if len(g) < 2:
        return -np.inf, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gains = _gain(left_g, left_h) + _gain(right_g, right_h) - _gain(g.sum(), h.sum())
    gains = np.where(np.minimum(left_h, right_h) * 4 >= LEAF_WEIGHT / 4, gains, -np.inf)
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Leaf values by bin of a tree of one feature, grown best first."""
    parts = [(0, len(g))]
    splits = [_best_split(g, h)]
    while len(parts) < leaves:
        best = max(range(len(parts)), key=lambda k: splits[k][0])
        gain, at = splits[best]
        if gain <= 1e-9:
            break
        lo, hi = parts[best]
        parts[best : best + 1] = [(lo, lo + at), (lo + at, hi)]
        splits[best : best + 1] = [_best_split(g[a:b], h[a:b]) for a, b in parts[best : best + 2]]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + SHRINK)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree that cuts one feature of a pair and then each side by the other."""
    best: tuple[float, np.ndarray] = (0.0, np.zeros_like(g))
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(gg)):
            out, total = np.zeros_like(gg), -_gain(gg.sum(), hh.sum())
            for side in (slice(0, cut), slice(cut, None)):
                out[side] = _tree(gg[side].sum(axis=0), hh[side].sum(axis=0), 2)
                value = out[side][0]
                for leaf in np.unique(value):
                    own = value == leaf
                    total += _gain(gg[side][:, own].sum(), hh[side][:, own].sum())
            if total > best[0]:
                best = (float(total), out.T.copy() if flip else out)
    return best


def train(rows: np.ndarray, labels: np.ndarray) -> Model:
    """The model of the training rows, whose labels are 0 and 1."""
    n, k = rows.shape
    rows = rows.astype(np.float32)
    share = (labels.sum() + 0.5) / (n + 1)
    intercept = float(np.log(share / (1 - share)))
    cuts = [_cuts(rows[:, j], BINS) for j in range(k)]
    coarse = [_cuts(rows[:, j], COARSE) for j in range(k)]
    bins = [np.searchsorted(c, rows[:, j], side="left") for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(n, intercept)
    for _ in range(ROUNDS if n else 0):
        for j in range(k):
            p = 1 / (1 + np.exp(-total))
            g = np.bincount(bins[j], labels - p, minlength=len(tables[j]))
            h = np.bincount(bins[j], p * (1 - p), minlength=len(tables[j]))
            step = RATE * _tree(g, h)
            tables[j] += step
            total += step[bins[j]]
    coarse_bins = [np.searchsorted(c, rows[:, j], side="left") for j, c in enumerate(coarse)]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell = coarse_bins[a] * shape[1] + coarse_bins[b]
        return tuple(np.bincount(cell, x, minlength=shape[0] * shape[1]).reshape(shape) for x in (labels - p, p * (1 - p)))

    # what a pair's cells still explain beyond its rows and columns
    strength = {}
    for a in range(k):
        for b in range(a + 1, k):
            g, h = grid(a, b)
            strength[a, b] = _gain(g, h).sum() - _gain(g.sum(axis=0), h.sum(axis=0)).sum() - _gain(g.sum(axis=1), h.sum(axis=1)).sum()
    pairs = sorted(strength, key=lambda pair: (-strength[pair], pair))[:PAIRS] if n else []
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for at, (a, b) in enumerate(pairs):
            step = RATE * _pair_tree(*grid(a, b))[1]
            pair_tables[at] += step
            total += step[coarse_bins[a], coarse_bins[b]]
    return Model(intercept, cuts, tables, pairs, coarse, pair_tables)


def fit(rows: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """The model of `rows` (id, features) by `labels` (id, label), without the held-out fold."""
    own = labels.where(~held_out(F.col("id")) & F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    order = F.shiftrightunsigned(F.xxhash64("id"), 32)
    # rows are counted by their ids alone; of many, only a share of the ids is joined with features and
    # sorted, which is doubled where rows of one id leave it too small
    known = rows.where("id is not null").select("id").join(own.select("id"), "id").count()
    share = min(1.0, 1.5 * train_rows / max(known, 1))
    while True:
        some = own.where(order < F.lit(int(share * 2**32)))
        joined = rows.where("id is not null").where(order < F.lit(int(share * 2**32))).join(some, "id").select("id", "label", "features")
        sample = joined.orderBy(order, "id", F.col("features")).limit(train_rows).toPandas()
        if share == 1 or len(sample) >= train_rows:
            break
        share = min(1.0, 2 * share)
    table = np.stack(sample["features"].to_numpy()).astype(np.float32) if len(sample) else np.zeros((0, len(FEATURES)), np.float32)
    return train(table, sample["label"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, folder: str | None = None) -> DataFrame:
    """id_col, held_out, score (0 to 1) and predicted (1 from THRESHOLD on) of each document."""
    folder = folder or shared_dir(docs.sparkSession)
    rows = stored(measured(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), f"{folder}/features")
    model = fit(rows, labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")), train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            scores = shared.value.score(flat)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.select("id", held_out(F.col("id")).alias("held_out"), "features").mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int")
    return made.withColumnRenamed("id", id_col)
