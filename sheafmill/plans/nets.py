"""The models of a run. None are shipped: each is a loader of a model (rows in, as many rows out), and the
built-in ones find nothing. A run's models are made by a function of its settings and engine files.

| Model | takes | gives |
|-|-|-|
| layout | h, w, data (a page), chars | items: a list of label, bbox, score, text |
| formula | h, w, data (a padded crop) | latex |
| detect | h, w, data (a padded crop) | quads: lists of four points in the crop |
| reader | h, w, data (a straightened line), padded_w | text, score |
| classify | h, w, data (a padded table) | turns (quarters to turn it by), cls_label, cls_score |
| wireless, wired | h, w, data (the table), ocr_result | html |
| seal | h, w, data (a padded crop) | seal_texts |
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.models import Loader
from .config import Settings

BOX = "struct<x0:int,y0:int,x1:int,y1:int>"
ITEM = f"struct<label:string,bbox:{BOX},score:double,text:string>"
QUADS = "array<array<struct<x:double,y:double>>>"
#: Columns that each model adds.
ADDED = {
    "layout": f"items array<{ITEM}>", "formula": "latex string", "detect": f"quads {QUADS}", "classify": "turns int, cls_label string, cls_score double",
    "wireless": "html string", "wired": "html string", "seal": "seal_texts array<string>",
}


def constant(**values) -> Loader:
    """A loader of a model that gives the same for every row."""
    return lambda: lambda rows: pd.DataFrame({name: [value] * len(rows) for name, value in values.items()})


def as_they_are(rows: DataFrame) -> DataFrame:
    return rows


@dataclass(frozen=True)
class Nets:
    layout: Loader = constant(items=[])
    formula: Loader = constant(latex="")
    detect: Loader = constant(quads=[])
    reader: Loader = constant(text="", score=0.0)
    classify: Loader = constant(turns=0, cls_label="WirelessTable", cls_score=1.0)
    wireless: Loader = constant(html="")
    wired: Loader = constant(html="")
    seal: Loader = constant(seal_texts=[])
    #: Items after the layout, such as split or merged ones.
    split: Callable[[DataFrame], DataFrame] = as_they_are
    #: Detected lines (KEY, line_id, quad) merged, and those of pages that have formulas updated by these.
    merge: Callable[[DataFrame], DataFrame] = as_they_are
    update: Callable[[DataFrame, DataFrame], DataFrame] = lambda lines, formulas: lines


#: Makes a run's models of the engine files that are there, by their setting's name, and its settings.
Factory = Callable[[dict[str, str], Settings], Nets]


def nothing(engines: dict[str, str], settings: Settings) -> Nets:
    return Nets()


def named(name: str) -> Callable:
    """The function named `module:function`."""
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def factory(name: str | None) -> Factory:
    return named(name) if name else nothing
