"""Batch models as pluggable functions: a pandas or Arrow worker loads its model once per process.

No weights are shipped. A stage is given a loader; the built-in ones are small deterministic stand-ins
for tests and for trying plans. Each stage is DataFrame to DataFrame and keeps an ordinal, so that
results return to their inputs by key whatever order a worker takes them in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import windows

#: A model takes a batch of rows and returns as many, in order.
Model = Callable[[pd.DataFrame], pd.DataFrame]
Loader = Callable[[], Model]

#: Beyond the stand-in's vocabulary, so that it can't be mistaken for a token.
PAD = 99

_loaded: dict[Any, Model] = {}


def loaded(key: Any, loader: Loader) -> Model:
    """The worker's model of a key (a tuple that begins with the model's kind)."""
    if key not in _loaded:
        _loaded[key] = loader()
    return _loaded[key]


def with_fallback(fast: Model, slow: Model) -> Model:
    """The fast model; where it fails or returns nothing, the slow one. Adds used_fast."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            out = fast(rows)
        except Exception:  # noqa: BLE001 - any failure of the fast engine means the other one
            out = None
        return slow(rows).assign(used_fast=False) if out is None else out.assign(used_fast=True)

    return run


def routed(fast: Model, slow: Model, fits: Callable[[pd.DataFrame], np.ndarray]) -> Model:
    """The fast model for the rows that `fits` says it takes, the slow one for the others, in one order.
    Adds used_fast."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        inside = np.asarray(fits(rows), bool)
        parts = [(model(rows[own]).assign(used_fast=used), np.flatnonzero(own)) for model, own, used in ((fast, inside, True), (slow, ~inside, False)) if own.any()]
        if not parts:
            return slow(rows).assign(used_fast=False)
        out = pd.concat([made for made, _ in parts], ignore_index=True)
        return out.iloc[np.argsort(np.concatenate([at for _, at in parts]), kind="stable")].reset_index(drop=True)

    return run


def expect_shapes(tensors: dict[str, Sequence[int]], expected: dict[str, Sequence[int | None]]) -> None:
    """Raises ValueError unless the named tensors have the expected shapes, None being any size."""
    for name, want in expected.items():
        have = tensors.get(name)
        if have is None or len(have) != len(want) or any(w is not None and h != w for h, w in zip(have, want)):
            raise ValueError(f"{name} has shape {have and tuple(have)}, not {tuple(want)}")


def expect_columns(df: DataFrame, expected: str) -> DataFrame:
    """The frame, if it has the columns of a schema text with these types; else ValueError."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = {f.name: f.dataType.simpleString() for f in T._parse_datatype_string(expected).fields}
    if wrong := {k: have.get(k) for k, kind in want.items() if have.get(k) != kind}:
        raise ValueError(f"expected {', '.join(f'{k} {want[k]}' for k in wrong)}; have {wrong}")
    return df


def chunked(rows: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    for at in range(0, len(rows), size):
        yield rows.iloc[at : at + size]


def _ready(key: Any, loader: Loader, warm_up: pd.DataFrame | None) -> Model:
    """The worker's model, warmed up when it is first loaded."""
    fresh = key not in _loaded
    model = loaded(key, loader)
    if fresh and warm_up is not None:
        model(warm_up)
    return model


def apply_model(df: DataFrame, key: Any, loader: Loader, schema: str, batch: int = 64, warm_up: pd.DataFrame | None = None) -> DataFrame:
    """`df` through a model in chunks of `batch` rows; a worker warms its model up once if asked to."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _ready(key, loader, warm_up)
        for frame in frames:
            for part in chunked(frame, batch):
                out = model(part)
                if len(out) != len(part):
                    raise ValueError(f"{key}: {len(out)} results for {len(part)} rows")
                yield out

    return df.mapInPandas(run, schema)


def apply_in_batches(df: DataFrame, keys: Sequence[str], order: Sequence[str], key: Any, loader: Loader, added: str, warm_up: pd.DataFrame | None = None) -> DataFrame:
    """`df` with the columns `added` that a model gives, one call per batch of equal `keys`, whose rows it
    sees in `order`. Batches are sorted within tasks and cut there; one that goes on in the next Arrow frame
    is carried over. The number of tasks is given, as a few bytes may stand for much work."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f.split()[0] for f in added.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _ready(key, loader, warm_up)

        def done(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
            parts = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                parts.append(model(rows.iloc[a:b]))
                if len(parts[-1]) != b - a:
                    raise ValueError(f"{key}: {len(parts[-1])} results for {b - a} rows")
            out = pd.concat(parts, ignore_index=True)
            return rows.reset_index(drop=True).assign(**{n: out[n] for n in names})

        held: pd.DataFrame | None = None
        for frame in frames:
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(rows):
                continue
            codes = np.stack([pd.factorize(rows[k])[0] for k in keys])  # a null is a batch key of its own
            cuts = np.flatnonzero(np.append(True, (codes[:, 1:] != codes[:, :-1]).any(axis=0)))
            if len(cuts) > 1:
                yield done(rows.iloc[: cuts[-1]], cuts)
            held = rows.iloc[cuts[-1] :]
        if held is not None and len(held):
            yield done(held, np.array([0, len(held)]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{fields}, {added}")


def greedy_decode(hidden: np.ndarray, step: Callable[[np.ndarray, np.ndarray], np.ndarray], eos: int, pad: int, max_len: int, max_batch: int = 32, start: int = 0) -> np.ndarray:
    """Token ids of each row of `hidden`, from `start` on. `step` gives the logits of the next token
    for (hidden, ids so far). A finished row goes on with `pad`; a block ends when all its rows have
    met `eos` or at `max_len`. Blocks of `max_batch` rows are decoded apart and padded to one length."""
    blocks = [_decode_block(hidden[at : at + max_batch], step, eos, pad, max_len, start) for at in range(0, len(hidden), max_batch)]
    width = max((b.shape[1] for b in blocks), default=1)
    return np.concatenate([np.pad(b, ((0, 0), (0, width - b.shape[1])), constant_values=pad) for b in blocks]) if blocks else np.zeros((0, 1), np.int64)


def _decode_block(hidden: np.ndarray, step, eos: int, pad: int, max_len: int, start: int) -> np.ndarray:
    ids = np.full((len(hidden), 1), start, np.int64)
    going = np.ones(len(hidden), bool)
    for _ in range(max_len):
        token = np.where(going, np.argmax(step(hidden, ids), axis=1), pad)
        ids = np.concatenate([ids, token[:, None]], axis=1)
        going &= token != eos
        if not going.any():
            break
    return ids


def stub_step(vocabulary: int = 16) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A step that counts down from a row's first number to 1, the end token."""

    def step(hidden: np.ndarray, ids: np.ndarray) -> np.ndarray:
        want = np.maximum(hidden[:, 0].astype(int) - ids.shape[1] + 1, 1) % vocabulary
        return np.eye(vocabulary)[want]

    return step


def formula_model(step: Callable[[np.ndarray, np.ndarray], np.ndarray], tokens: Callable[[Sequence[int]], str], eos: int = 1, pad: int = PAD, max_len: int = 32) -> Loader:
    """A loader of a model that decodes a batch's `hidden` by a step function and spells its tokens."""

    def read(rows: pd.DataFrame) -> pd.DataFrame:
        ids = greedy_decode(np.stack(rows["hidden"].to_numpy()), step, eos, pad, max_len)
        return pd.DataFrame({"latex": [tokens([t for t in row if t != pad]) for row in ids.tolist()]})

    return lambda: read


def spelled(ids: Sequence[int]) -> str:
    return " ".join(map(str, ids))


def recognise_formulas(formulas: DataFrame, batch: int = 64, loader: Loader | None = None, key: Any = ("mfr",)) -> DataFrame:
    """Formulas (formula_id, area, hidden) with latex, decoded in chunks of half a batch in order of their
    area over all rows, so that what is decoded together is of like size."""
    chunks = windows.sorted_chunks(formulas, "area", "formula_id", max(1, batch // 2), "__chunk")
    made = apply_in_batches(chunks, ["__chunk"], ["area", "formula_id"], key, loader or formula_model(stub_step(), spelled), "latex string")
    return made.drop("__chunk").withColumn("latex", F.coalesce("latex", F.lit("")))


def recognise_lines(lines: DataFrame, loader: Loader, key: Any = ("ocr_rec",), warm_up: pd.DataFrame | None = None) -> DataFrame:
    """Lines (lang, batch_id, line_id, ...) with text and score, one call per batch; a score that isn't
    a number is 0."""
    made = apply_in_batches(lines, ["lang", "batch_id"], ["line_id"], key, loader, "text string, score double", warm_up)
    # on its way from pandas a number that isn't one may become null
    return made.withColumn("score", F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)))


def onnx_model(path: str, feed: Callable[[pd.DataFrame], dict[str, np.ndarray]], spell: Callable[[pd.DataFrame, list[np.ndarray]], pd.DataFrame], most: int | None = None) -> Loader:
    """A loader of a network file of the onnxruntime library, opened once a worker: `feed` makes its inputs
    from rows, `spell` rows from its outputs. At most `most` rows are run at once, the profile's own limit."""

    def load() -> Model:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=onnxruntime.get_available_providers())

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.concat([spell(part, session.run(None, feed(part))) for part in chunked(rows, most or max(1, len(rows)))], ignore_index=True)

        return run

    return load


def ctc_text(indices: Sequence[int], alphabet: str, blank: int = 0) -> str:
    """Characters of a best path: repeats merged, blanks dropped."""
    before, out = blank, []
    for i in indices:
        if i != before and i != blank:
            out.append(alphabet[i - 1])
        before = i
    return "".join(out)
