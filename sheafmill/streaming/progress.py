"""Progress and timings of running work, without touching the plans' results."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls back with (batch number, input rows) after each micro-batch that had any."""

    def __init__(self, on_batch: Callable[[int, int], None]) -> None:
        self._on_batch = on_batch

    def onQueryStarted(self, event) -> None:  # noqa: N802 - names of the interface
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if event.progress.numInputRows:
            self._on_batch(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


class StageTimer:
    """Rows and wall time of named stages: `watch` a frame, `time` the action that runs it."""

    def __init__(self) -> None:
        self._observed: dict[str, Observation] = {}
        self.rows: list[tuple[str, float]] = []

    def watch(self, name: str, frame: DataFrame) -> DataFrame:
        self._observed[name] = Observation(name)
        return frame.observe(self._observed[name], F.count(F.lit(1)).alias("rows"))

    def time(self, name: str, action: Callable[[], object]) -> object:
        began = time.perf_counter()
        try:
            return action()
        finally:
            self.rows.append((name, (time.perf_counter() - began) * 1000))

    def counts(self) -> dict[str, int]:
        """Rows that went through each watched stage whose action has run."""
        return {name: o.get["rows"] for name, o in self._observed.items()}
