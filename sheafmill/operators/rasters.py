"""Pixel kernels over rows of images: h, w and data, h x w x 3 bytes. A row is an image, so work within
it is vectorised and the loop over rows costs little. Other columns go along.

Boxes and quads meet their image in one row, gathered by image, which bounds them by what a page holds.
An image without pixels gives an image without pixels, or a null tensor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels

IMAGE = "h int, w int, data binary"
TENSOR = "shape array<int>, tensor array<float>"
#: Bytes of pixels or numbers that a task makes before it hands them on, besides those of one row.
PIECE = 1 << 22

Row = dict[str, Any]


def pixels_of(row: Row) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(row["h"], row["w"], 3)


def image_row(image: np.ndarray) -> Row:
    return {"h": image.shape[0], "w": image.shape[1], "data": np.ascontiguousarray(image).tobytes()}


def tensor_row(tensor: np.ndarray | None) -> Row:
    return {"shape": None if tensor is None else list(tensor.shape), "tensor": None if tensor is None else tensor.ravel()}


def _bytes(row: Row) -> int:
    made = row["data"] if "data" in row else row["tensor"]
    return 0 if made is None else memoryview(made).nbytes


def _in_pieces(frame: pd.DataFrame, make: Callable[[Row], Sequence[Row]]) -> Iterator[tuple[int, list[Sequence[Row]]]]:
    """What `make` gives for the rows of a frame, in pieces of some bytes of pixels, with the place of their first row."""
    found: list[Sequence[Row]] = []
    at, held = 0, 0
    for k, values in enumerate(zip(*(frame[c].tolist() for c in frame.columns))):
        found.append(make(dict(zip(frame.columns, values))))
        held += sum(_bytes(row) for row in found[-1])
        if held >= PIECE:
            yield at, found
            at, held, found = k + 1, 0, []
    if found or not len(frame):
        yield at, found


def _mapped(images: DataFrame, make: Callable[[Row], Sequence[Row]], made: str, used: Sequence[str] = ()) -> DataFrame:
    """`images` without their pixels and the columns `used`, and with what `make` gives for each row."""
    kept = [f for f in images.schema.fields if f.name not in ("h", "w", "data", *used)]
    names = [part.split()[0] for part in made.split(", ")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), made])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, found in _in_pieces(frame, make):
                rest = frame.iloc[np.repeat(np.arange(at, at + len(found)), list(map(len, found)))][[f.name for f in kept]].reset_index(drop=True)
                rows = [row for several in found for row in several]
                yield rest.assign(**{n: pd.Series([row[n] for row in rows], dtype=object if n in ("data", "shape", "tensor") else None) for n in names})

    return images.mapInPandas(run, schema)


def _with_list(images: DataFrame, rows: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Images with the array of their rows; empty without any."""
    lists = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*(c for c in rows.columns if c not in key)))).alias(name))
    return images.join(lists, list(key), "left")


def _items(values: Any) -> list:
    return [] if values is None else list(values)


def det_inputs(images: DataFrame, h: Column, w: Column) -> DataFrame:
    """The detector's input of each image, 3 x h x w, normalised by channel."""
    sized = images.withColumns({"__h": h.cast("int"), "__w": w.cast("int")})
    make = lambda row: [tensor_row(pixels.det_input(pixels_of(row), row["__h"], row["__w"]) if row["h"] and row["w"] else None)]
    return _mapped(sized, make, TENSOR, ("__h", "__w"))


def crops(images: DataFrame, boxes: DataFrame, key: Sequence[str], id_col: str, paste: int = 50) -> DataFrame:
    """`boxes` (key, id_col, bbox) as images with a white margin and reversed channels."""
    kind = boxes.schema[id_col].dataType.simpleString()

    def make(row: Row) -> list[Row]:
        page = pixels_of(row)
        return [{id_col: b[id_col], **image_row(pixels.crop_reversed(page, *(b["bbox"][k] for k in ("x0", "y0", "x1", "y1")), paste))} for b in _items(row["__boxes"])]

    pairs = _with_list(images.select(*key, "h", "w", "data"), boxes.select(*key, id_col, "bbox"), key, "__boxes")
    return _mapped(pairs.where(F.size("__boxes") > 0), make, f"{id_col} {kind}, {IMAGE}", ("__boxes",))


def masked(images: DataFrame, boxes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Images with all half-open boxes (key, bbox) white."""

    def make(row: Row) -> list[Row]:
        found = [[b["bbox"][k] for k in ("x0", "y0", "x1", "y1")] for b in _items(row["__boxes"])]
        return [image_row(pixels.mask_boxes(pixels_of(row), np.array(found).reshape(-1, 4)))]

    return _mapped(_with_list(images, boxes.select(*key, "bbox"), key, "__boxes"), make, IMAGE, ("__boxes",))


def warped(images: DataFrame, matrix: Column, h: Column, w: Column) -> DataFrame:
    """Images of size h x w, of which each pixel's source is given by a matrix, nine numbers by row."""
    sized = images.withColumns({"__m": matrix, "__h": h.cast("int"), "__w": w.cast("int")})
    make = lambda row: [image_row(pixels.warp(pixels_of(row), np.array(row["__m"]), row["__h"], row["__w"]) if row["h"] and row["w"] else pixels_of(row))]
    return _mapped(sized, make, IMAGE, ("__m", "__h", "__w"))


def line_inputs(images: DataFrame, content: Column, width: Column, height: int = 48) -> DataFrame:
    """The recogniser's input of each line, 3 x height x width: the line `content` wide, zeros behind it."""
    sized = images.withColumns({"__content": content.cast("int"), "__width": width.cast("int")})
    make = lambda row: [tensor_row(pixels.line_input(pixels_of(row), row["__content"], row["__width"], height) if row["h"] and row["w"] else None)]
    return _mapped(sized, make, TENSOR, ("__content", "__width"))


def formula_inputs(images: DataFrame, side: int = 384) -> DataFrame:
    """The formula encoder's input of each image, 1 x side x side."""
    make = lambda row: [tensor_row(pixels.formula_batch([pixels_of(row)], side)[0] if row["h"] and row["w"] else None)]
    return _mapped(images, make, TENSOR)


def line_crops(images: DataFrame, quads: DataFrame, key: Sequence[str], id_col: str) -> DataFrame:
    """`quads` (key, id_col, quad) as images, straightened, and turned if they are much taller than wide."""
    kind = quads.schema[id_col].dataType.simpleString()

    def make(row: Row) -> list[Row]:
        page = pixels_of(row)
        corners = [(q[id_col], np.array([[p["x"], p["y"]] for p in q["quad"]])) for q in _items(row["__quads"])]
        return [{id_col: k, **image_row(pixels.upright(pixels.crop_line(page, quad)))} for k, quad in corners]

    pairs = _with_list(images.select(*key, "h", "w", "data"), quads.select(*key, id_col, "quad"), key, "__quads")
    return _mapped(pairs.where(F.size("__quads") > 0), make, f"{id_col} {kind}, {IMAGE}", ("__quads",))


def turned(images: DataFrame, ratio: float = 1.5) -> DataFrame:
    """Images, those much taller than wide turned by a quarter."""
    return _mapped(images, lambda row: [image_row(pixels.upright(pixels_of(row), ratio))], IMAGE)


def quarter_turned(images: DataFrame, turns: Column) -> DataFrame:
    """Images turned by a number of quarters, against the clock."""
    make = lambda row: [image_row(np.rot90(pixels_of(row), int(row["__turns"])))]
    return _mapped(images.withColumn("__turns", turns.cast("int")), make, IMAGE, ("__turns",))


def decoded(rows: DataFrame) -> DataFrame:
    """Images of Spark's own image source (column image), with its path."""
    plain = rows.select("image.origin", "image.height", "image.width", "image.nChannels", F.col("image.data").alias("raw"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [image_row(pixels.decode_row({**row, "data": row["raw"]})) for row in frame.to_dict("records")]
            yield frame[["origin"]].rename(columns={"origin": "path"}).assign(**{k: [m[k] for m in made] for k in ("h", "w", "data")})

    return plain.mapInPandas(run, f"path string, {IMAGE}")
