"""Near duplicates: banded MinHash candidates, odd sketches and exact Jaccard links.

A text's set is its distinct three-word shingles, A-Z lower-cased. Texts with equal sets are one
class, represented by its smallest id; only representatives go on. `SAMPLES` MinHash values of each
give BANDS keys of ROWS values, and an odd sketch: every sample flips one of SKETCH_BITS parity bits,
so that the population count of two sketches' XOR estimates how many samples differ. A pair that
shares a key is a candidate; it is dropped only if its sketches put it below `SKETCH_LEAST`, more than
five standard deviations below the limit of a link, and confirmed on both full sets otherwise. Two sets at the limit
share no key with probability (1 - 0.85**5)**20 < 1e-5, less above it.

No bucket is expanded into pairs. First each member is held against its bucket's smallest id, one pair
per member at most, which makes one component of a group of copies however large. Pairs of the rest
are compared only across components and by sketch, in blocks of at most BLOCK members: a bucket's largest
component is held against the others, so that one stray in a hot bucket costs a comparison a member. What
moves between rounds is ids, and texts of confirmed candidates.

All links lie within components. A component of two classes is one link; of a larger one each class's
text meets all others once, on full sets, in blocks of bounded members and shingles, and what leaves a
block is a number per class, or the pairs themselves if these are asked for (`links`).

Defined results: texts that are null or without words have the empty set and are linked with nothing;
rows without an id neither, and have no component (kept is true); rows that share an id are one
document, linked through each of their texts, while n_links is that of the row's own set; an empty
table gives an empty result; texts of any length count whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_filter, may_be_in, mix64, quoted, random64, shared_dir, stored, text_batches, utf8, without
from .words import Words, trigrams

ROWS, BANDS, SAMPLES, SKETCH_BITS = 5, 20, 256, 512
#: A link has 100 * |intersection| >= LEAST * |union|.
LEAST = 85
SKETCH_LEAST = 0.70
#: Members of a block, and about how many shingles a block's sets hold together.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Pairs of members that a task compares, about two blocks' own.
TASK_PAIRS = 1 << 21

_MULTIPLY = (random64(SAMPLES, 31) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_FLIP = (random64(SAMPLES, 32) >> np.uint64(32)).astype(np.uint32)
_BAND, _PLACE, _SAMPLE = random64(BANDS, 33), random64(ROWS, 34) | np.uint64(1), random64(SAMPLES, 35)
_STEP = 1 << 14
#: Shingles that all pairs of a block are compared by at a time.
_COLUMNS = 1 << 13


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, and n + 1 bounds by text."""
    words = Words(data, offsets)
    hashes, bounds = trigrams(words, words.hashes(lower=True))
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        hashes[lo:hi].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[bounds[:-1][bounds[:-1] < len(hashes)]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def set_sums(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two sums of each text's set, which identify it."""
    sums = []
    for values in (hashes, mix64(hashes)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return sums


def samples(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SAMPLES MinHash values of each text, a row each; 2**32 - 1 for empty sets."""
    n = len(bounds) - 1
    out = np.full((n, SAMPLES), np.uint32(0xFFFFFFFF))
    filled = np.flatnonzero(np.diff(bounds))
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    at = 0
    while at < len(filled):  # a few texts at a time, so that the work stays in the cache
        upto = max(at + 1, int(np.searchsorted(bounds[filled], bounds[filled[at]] + _STEP)))
        rows = filled[at:upto]
        part = short[bounds[rows[0]] : bounds[rows[-1] + 1]]
        starts = bounds[rows] - bounds[rows[0]]
        for k in range(SAMPLES):
            out[rows, k] = np.minimum.reduceat((part ^ _FLIP[k]) * _MULTIPLY[k], starts)
        at = upto
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    parts = mins[:, : ROWS * BANDS].astype(np.uint64).reshape(len(mins), BANDS, ROWS)
    return mix64((mix64(parts + _PLACE) * _PLACE).sum(axis=2, dtype=np.uint64) ^ _BAND)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """The parity bitmap of each row of samples, as SKETCH_BITS // 64 numbers."""
    bit = (mix64(mins.astype(np.uint64) ^ _SAMPLE) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flips = np.bincount((bit + np.arange(len(mins))[:, None] * SKETCH_BITS).ravel(), minlength=len(mins) * SKETCH_BITS)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.uint64).reshape(len(mins), -1)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of sketches: of m flips, S (1 - exp(-2 m / S)) / 2 bits are odd."""
    odd = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    rest = np.maximum(1 - 2 * odd / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / 4 * np.log(rest) / SAMPLES


def _sketch_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint64).reshape(batch.num_rows, -1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, "text"):
        hashes, bounds = shingles(*utf8(batch.column("text")))
        size = np.diff(bounds)
        mins = samples(hashes, bounds)
        sums = map(pa.array, set_sums(hashes, bounds))
        keys = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(size) + 1, BANDS), pa.int32()), pa.array(band_keys(mins).view(np.int64).ravel()))
        sketches = pa.array([row.tobytes() for row in odd_sketches(mins)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size), *sums, keys, sketches], ["id", "size", "sum_a", "sum_b", "keys", "sketch"])


def signatures(docs: DataFrame) -> DataFrame:
    """id, set size, two sums that identify the set, band keys and odd sketch of each row (id, text)."""
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(_sign, f"id {kind}, size long, sum_a long, sum_b long, keys array<long>, sketch binary")


# -- candidates --------------------------------------------------------------------------------


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            close = estimate(_sketch_column(batch, "sketch_a"), _sketch_column(batch, "sketch_b")) >= SKETCH_LEAST
            yield batch.filter(pa.array(close)).select(["a", "b"])


def star_pairs(members: DataFrame, leads: DataFrame, marks: DataFrame, kind: str) -> DataFrame:
    """For each member its smallest lead of all its buckets that its sketch is close to."""
    pairs = members.join(leads, "key").where("id != lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    a, b = (marks.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    both = pairs.join(a, "a").join(b, "b").where(f"100 * least(size_a, size_b) >= {LEAST} * greatest(size_a, size_b)")
    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_likely, f"a {kind}, b {kind}").groupBy("a").agg(F.min("b").alias("b"))


def _group_pairs(groups: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Likely pairs of different components within each run of equal (key, i, j). Where i is negative,
    the run's first rows, of side 0, are held against the others."""
    batch = pa.Table.from_batches(groups).combine_chunks().to_batches()[0]
    column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "side", "block", "comp", "size")}
    ids, sketch = batch.column("id"), _sketch_column(batch, "sketch")
    starts = _runs([column[c] for c in ("key", "i", "j")])
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(batch.num_rows)  # rows from here to its run's end
    across = column["i"] < 0
    rows, ahead = np.flatnonzero(~across | (column["side"] == 0)), 1
    found_a, found_b = [], []
    while True:
        rows = rows[left[rows] > ahead]
        if not len(rows):
            break
        other = rows + ahead
        small, large = np.minimum(column["size"][rows], column["size"][other]), np.maximum(column["size"][rows], column["size"][other])
        fits = (column["comp"][rows] != column["comp"][other]) & (100 * small >= LEAST * large)
        fits &= np.where(across[rows], column["side"][other] == 1, (column["i"][rows] == column["j"][rows]) | (column["block"][rows] != column["block"][other]))
        a, b = rows[fits], other[fits]
        close = estimate(sketch[a], sketch[b]) >= SKETCH_LEAST
        found_a.append(a[close])
        found_b.append(b[close])
        ahead += 1
    if found_a:
        a, b = pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))
        yield pa.RecordBatch.from_arrays([ids.take(a), ids.take(b)], ["a", "b"])


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    new = np.ones(len(columns[0]) + 1, bool)
    if len(columns[0]):
        new[1:-1] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _by_run(batches: Iterator[pa.RecordBatch], name: tuple[str, ...]) -> Iterator[list[pa.RecordBatch]]:
    """Sorted rows in lists that hold whole runs of equal columns `name`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = tuple(batch.column(c)[-1].as_py() for c in name)
        same = np.ones(batch.num_rows, bool)
        for c, value in zip(name, last):
            same &= batch.column(c).to_numpy(zero_copy_only=False) == value
        cut = int(np.argmax(same))  # the run that may go on begins here
        if cut or held and tuple(held[-1].column(c)[-1].as_py() for c in name) != last:
            yield [*held, batch.slice(0, cut)]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield held


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for groups in _by_run(batches, ("key", "i", "j")):
        yield from _group_pairs(groups)


def rest_pairs(members: DataFrame, marks: DataFrame, comps: DataFrame, kind: str) -> DataFrame:
    """Likely pairs of all buckets whose members aren't of one component yet."""
    own = members.join(comps, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    parts = own.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    mixed = mixed.select("key", F.col("top.comp").alias("top"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("high"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("low"))
    rows = own.join(mixed, "key").withColumn("side", (F.col("comp") == F.col("top")).cast("int"))
    high, low, side = F.col("high"), F.col("low"), F.col("side")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.when(side == 1, high).otherwise(low)).cast("int"))
    group = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    # blocks of the largest component have negative numbers and meet those of all others
    upper = F.transform(F.sequence(F.lit(0), low - 1), lambda k: group(-1 - F.col("block"), k))
    lower = F.concat(F.transform(F.sequence(F.lit(0), high - 1), lambda k: group(-1 - k, F.col("block"))), F.transform(F.sequence(F.lit(0), low - 1), lambda k: group(F.least("block", k), F.greatest("block", k))))
    rows = rows.select("key", "side", "block", "id", "comp", F.explode(F.when(side == 1, upper).otherwise(lower)).alias("g"))
    rows = rows.select("key", "g.i", "g.j", "side", "block", "id", "comp").join(marks.select("id", "size", "sketch"), "id")
    rows = rows.select("key", "i", "j", "side", "block", "id", "comp", "size", "sketch")
    sorted_rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    pairs = sorted_rows.mapInArrow(_block_pairs, f"a {kind}, b {kind}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# -- links -------------------------------------------------------------------------------------


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_batches(iter([whole]), "text_a"):
            sets = [shingles(*utf8(batch.column(c))) for c in ("text_a", "text_b")]
            keep = []
            for k in range(batch.num_rows):
                x, y = (hashes[bounds[k] : bounds[k + 1]] for hashes, bounds in sets)
                merged = np.concatenate([x, y])
                merged.sort()
                common = int(np.count_nonzero(merged[1:] == merged[:-1]))
                keep.append(common > 0 and 100 * common >= LEAST * (len(merged) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _texts(ids: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """The rows (id, text) whose id may be in `ids`, each once."""
    texts = docs.where(may_be_in(key_filter(ids), F.col("id"), docs.sparkSession))
    return texts.dropDuplicates(["id", "text"]) if repeated else texts


def confirmed(pairs: DataFrame, docs: DataFrame, kind: str, repeated: bool = False) -> DataFrame:
    """The pairs (a, b) whose full sets are linked. A text moves once to each side of its pairs; of a
    hot id's pairs, the one row of its text is repeated where adaptive execution splits them."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    texts = _texts(ids, docs, repeated)
    a, b = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").mapInArrow(_linked, f"a {kind}, b {kind}").distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """id and comp, its component's smallest id, of all ids in `edges` (a, b). Each round hooks every
    label to the smallest that it meets, shortens these chains to their ends and keeps the edges
    between labels that still differ; a round leaves half of a component's labels at most."""
    rest = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/edges-0")
    labels, n = None, 0
    while rest.take(1):
        n += 1
        hooks = stored(rest.groupBy("a").agg(F.min("b").alias("b")), f"{folder}/hooks-{n}-0")
        jump = 0
        while True:
            jump += 1
            ends = hooks.select(F.col("a").alias("b"), F.col("b").alias("end"))
            hooks = stored(hooks.join(ends, "b", "left").select("a", F.coalesce("end", "b").alias("b"), F.col("end").isNotNull().alias("moved")), f"{folder}/hooks-{n}-{jump}")
            if not hooks.where("moved").take(1):
                break
            hooks = hooks.drop("moved")
        hooks = hooks.drop("moved")
        if labels is None:
            labels = hooks.select(F.col("a").alias("id"), F.col("b").alias("comp"))
        else:
            known = labels.join(hooks.select(F.col("a").alias("comp"), F.col("b").alias("end")), "comp", "left").select("id", F.coalesce("end", "comp").alias("comp"))
            labels = stored(known.union(hooks.join(labels.select(F.col("id").alias("a")), "a", "left_anti")), f"{folder}/labels-{n}")
        for side in ("a", "b"):
            ends = hooks.select(F.col("a").alias(side), F.col("b").alias("end"))
            other = "b" if side == "a" else "a"
            rest = rest.join(ends, side, "left").select(F.coalesce("end", side).alias(side), other)
        rest = stored(rest.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/edges-{n}")
    if labels is None:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    roots = labels.select(F.col("comp").alias("id"), "comp").distinct()
    return labels.union(roots)


class _Graph(NamedTuple):
    #: id, size, class, sum_a and sum_b (null for empty sets and null ids) of each row.
    rows: DataFrame
    #: id and comp of all ids that are linked with others.
    comps: DataFrame
    #: id, size, sum_a and sum_b of each class's representative.
    sets: DataFrame
    texts: DataFrame
    repeated: bool
    kind: str
    folder: str


def _graph(docs: DataFrame, id_col: str, text_col: str, folder: str | None) -> _Graph:
    folder = folder or shared_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = stored(signatures(rows), f"{folder}/signed")
    repeated = bool(signed.where("id is not null").groupBy("id").count().where("count > 1").take(1))

    sets = signed.where("id is not null and size > 0")
    equal = sets.groupBy("sum_a", "sum_b").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    linkable = F.col("id").isNotNull() & (F.col("size") > 0)
    light = signed.select("id", "size", *(F.when(linkable, F.col(c)).alias(c) for c in ("sum_a", "sum_b")))
    classes = stored(light.join(equal, ["sum_a", "sum_b"], "left").select("id", "size", F.coalesce("first", "id").alias("class"), "sum_a", "sum_b"), f"{folder}/classes")
    # of a class, only the row of its representative is compared
    marks = sets.join(equal, ["sum_a", "sum_b"], "left").where("first is null or first = id").drop("first")
    marks = stored(marks.dropDuplicates(["id", "sum_a", "sum_b"]) if repeated else marks, f"{folder}/representatives")

    keyed = marks.select("id", F.explode("keys").alias("key"))
    leads = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("key", "lead")
    members = stored(keyed.join(leads, "key").distinct(), f"{folder}/members")
    compared = members.select("id").distinct()
    close = stored(marks.select("id", "size", "sketch").join(compared, "id", "left_semi"), f"{folder}/marks")

    stars = stored(star_pairs(members.select("key", "id"), members.select("key", "lead").distinct(), close, kind), f"{folder}/stars")
    first = components(stored(confirmed(stars, rows, kind, repeated), f"{folder}/links-a"), f"{folder}/a")
    pairs = stored(rest_pairs(members.select("key", "id"), close, first, kind), f"{folder}/rest")
    links = stored(confirmed(pairs, rows, kind, repeated), f"{folder}/links-b")
    again = first.select(F.col("id").alias("a"), F.col("comp").alias("b")).where("a != b").union(links)
    if repeated:  # rows that share an id join their classes
        several = classes.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").select("a", "b")
        again = again.union(several)
    found = stored(components(again, f"{folder}/b"), f"{folder}/found")
    return _Graph(classes, found, marks.select("id", "size", "sum_a", "sum_b"), rows, repeated, kind, folder)


def _within(graph: _Graph) -> tuple[DataFrame, DataFrame]:
    """The pairs of components that have two sets, and the rows of larger ones in blocks, with texts."""
    sets = graph.sets.join(graph.comps, "id")
    sizes = sets.groupBy("comp").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min(F.struct("id", "sum_a", "sum_b")).alias("a"), F.max(F.struct("id", "sum_a", "sum_b")).alias("b"))
    sizes = stored(sizes.where("n > 1"), f"{graph.folder}/components")
    # of two sets of one id nothing is known yet
    two = sizes.where("n = 2 and a.id < b.id").select("a", "b")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    rest = sizes.where("n > 2 or a.id = b.id").select("comp", blocks.alias("blocks"))
    rows = stored(sets.join(rest, "comp").withColumn("block", F.pmod(F.xxhash64("id", "sum_a"), F.col("blocks")).cast("int")), f"{graph.folder}/blocked")
    texts = _texts(rows.select("id"), graph.texts, graph.repeated)
    rows = rows.join(texts, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "sum_a", "sum_b", "text")
    # tasks by the pairs and shingles to compare, which few bytes may be many of
    cost = sizes.where("n > 2").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("total").alias("total")).first()
    tasks = max(cost.pairs or 0, (cost.total or 0) // 2) // TASK_PAIRS + 1
    most = 32 * graph.texts.sparkSession.sparkContext.defaultParallelism
    return two, rows.repartition(int(min(tasks, most)), "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "block")


def _common(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many members each of `sets` has in common with each of `others`, all sorted."""
    values = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (sets, others)]
    owner = [np.repeat(np.arange(len(x)), list(map(len, x))) for x in (sets, others)]
    shared = np.intersect1d(np.unique(values[0]), np.unique(values[1]), assume_unique=True)
    out = np.zeros((len(sets), len(others)), np.float32)
    places = [np.searchsorted(shared, v) for v in values]
    known = [np.flatnonzero((p < len(shared)) & (shared[np.minimum(p, len(shared) - 1)] == v)) if len(shared) else np.zeros(0, int) for p, v in zip(places, values)]
    order = [k[np.argsort(p[k], kind="stable")] for p, k in zip(places, known)]
    for at in range(0, len(shared), _COLUMNS):
        width, sides = min(_COLUMNS, len(shared) - at), []
        for p, o, own, n in zip(places, order, owner, out.shape):
            part = o[np.searchsorted(p[o], at) : np.searchsorted(p[o], at + width)]
            held = np.zeros((n, width), np.float32)
            held[own[part], p[part] - at] = 1
            sides.append(held)
        out += sides[0] @ sides[1].T
    return out


def _run_links(column: dict[str, np.ndarray], sets: list[np.ndarray], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all linked pairs of one run of equal (comp, i, j), each pair once."""
    size = np.array([len(s) for s in sets[lo:hi]])
    one = column["i"][lo] == column["j"][lo]
    cut = 0 if one else int(np.searchsorted(column["block"][lo:hi], column["block"][lo], side="right"))
    a, b = (slice(0, hi - lo), slice(0, hi - lo)) if one else (slice(0, cut), slice(cut, hi - lo))
    both = _common(sets[lo:hi][a], sets[lo:hi][b])
    linked = (both > 0) & (100 * both >= LEAST * (size[a][:, None] + size[b][None, :] - both))
    x, y = np.nonzero(np.triu(linked, 1) if one else linked)
    return x + lo, y + lo + (0 if one else cut)


def _blocked_links(batches: Iterator[pa.RecordBatch], counted: bool) -> Iterator[pa.RecordBatch]:
    """The links of sorted blocked rows: their number for each set, or the pairs of ids."""
    for groups in _by_run(batches, ("comp", "i", "j")):
        batch = pa.Table.from_batches(groups).combine_chunks().to_batches()[0]
        hashes, bounds = shingles(*utf8(batch.column("text")))
        column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("comp", "i", "j", "block", "sum_a", "sum_b")}
        own = set_sums(hashes, bounds)
        # an id that is repeated brings texts of other sets
        true = (own[0] == column["sum_a"]) & (own[1] == column["sum_b"])
        sets = [hashes[a:b] if t else hashes[:0] for a, b, t in zip(bounds[:-1], bounds[1:], true)]
        starts = _runs([column[c] for c in ("comp", "i", "j")])
        found = [_run_links(column, sets, lo, hi) for lo, hi in zip(starts[:-1], starts[1:])]
        a, b = (np.concatenate(x) for x in zip(*found))
        if counted:
            n = np.bincount(a, minlength=len(sets)) + np.bincount(b, minlength=len(sets))
            at = pa.array(np.flatnonzero(n))
            yield pa.RecordBatch.from_arrays([batch.column("sum_a").take(at), batch.column("sum_b").take(at), pa.array(n[n > 0])], ["sum_a", "sum_b", "n_links"])
        else:
            ids = batch.column("id")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["a", "b"])


def link_counts(graph: _Graph) -> DataFrame:
    """sum_a, sum_b and n_links of all sets that have links."""
    two, rows = _within(graph)
    ends = two.select("a.*").union(two.select("b.*")).select("sum_a", "sum_b", F.lit(1).cast("long").alias("n_links"))
    parts = rows.mapInArrow(lambda batches: _blocked_links(batches, True), "sum_a long, sum_b long, n_links long")
    return ends.union(parts.groupBy("sum_a", "sum_b").agg(F.sum("n_links").alias("n_links")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, counted: bool = True) -> DataFrame:
    """id_col (an integer column), n_shingles, class_id (smallest id with an equal set), component_id
    (smallest id reachable by links), kept (id = component_id) and, if `counted`, n_links (the number of
    other classes that the row's class is linked with) of each row."""
    graph = _graph(docs, id_col, text_col, folder)
    joined = graph.rows.join(graph.comps.withColumnRenamed("id", "class"), "class", "left")
    component, links = F.coalesce("comp", "class"), []
    if counted:
        joined = joined.join(stored(link_counts(graph), f"{graph.folder}/n-links"), ["sum_a", "sum_b"], "left")
        links = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    return joined.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.col("class").alias("class_id"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), *links)


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """All confirmed links (a, b), a < b, between the representatives of classes; `find` gives the
    members of each."""
    graph = _graph(docs, id_col, text_col, folder)
    two, rows = _within(graph)
    pairs = rows.mapInArrow(lambda batches: _blocked_links(batches, False), f"a {graph.kind}, b {graph.kind}")
    pairs = two.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).union(pairs.where("a != b"))
    made = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return made.distinct() if graph.repeated else made


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """One row of each component, with all its columns: that of the component's smallest id. Of several
    rows with that id the one with the smallest text stays; rows without an id all stay."""
    folder = folder or shared_dir(docs.sparkSession)
    found = stored(find(docs, id_col, text_col, folder, counted=False).select(F.col(id_col).alias("id"), "kept").where("id is not null"), f"{folder}/found")
    lost = found.where("not kept").select("id").distinct()
    again = stored(found.where("kept").groupBy("id").count().where("count > 1").select("id"), f"{folder}/again")
    rest = without(docs, lost.union(again), {"id": F.col(id_col)})
    if not again.take(1):
        return rest
    rows = docs.where(may_be_in(key_filter(again), F.col(id_col), docs.sparkSession))
    rows = rows.join(again.withColumnRenamed("id", id_col), id_col, "left_semi")
    one = rows.groupBy(id_col).agg(F.min_by(F.struct(*quoted(docs)), F.coalesce(F.col(text_col), F.lit(""))).alias("row"))
    return rest.union(one.select("row.*"))
