"""Settings of a run."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

METHODS = ("auto", "ocr", "txt")
PRECISIONS = ("fp16", "fp32", "tf32")


@dataclass(frozen=True)
class Settings:
    """Unset engine paths are resolved below `engines_dir`, the recogniser's by its precision."""

    engines_dir: str = "engines"
    encoder_engine: str | None = None
    decoder_init_engine: str | None = None
    decoder_past_engine: str | None = None
    det_engine: str | None = None
    rec_engine: str | None = None
    encoder_precision: str = "fp16"
    det_precision: str = "fp16"
    rec_precision: str = "tf32"
    method: str = "auto"
    lang: str = "en"
    output_dir: str = "output"
    window_pages: int = 64
    batch_ratio: int = 1
    rec_items: int = 6
    rec_budget: int = 5120
    min_confidence: float = 0.5
    min_width: float = 3.0
    formulas: bool = True
    tables: bool = True
    render: bool = True
    warm_up_pages: int = 1
    #: Seconds that rendering one page range may take; none is no limit.
    render_seconds: float | None = None

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"method is one of {', '.join(METHODS)}")
        for precision in (self.encoder_precision, self.det_precision, self.rec_precision):
            if precision not in PRECISIONS:
                raise ValueError(f"a precision is one of {', '.join(PRECISIONS)}")
        if self.window_pages < 1:
            raise ValueError("a window holds a page at least")

    def resolved(self) -> Settings:
        at = lambda given, name, precision: given or os.path.join(self.engines_dir, f"{name}{precision}.engine")
        encoder, rec = ("_fp16" if p == "fp16" else "" for p in (self.encoder_precision, self.rec_precision))
        return replace(
            self,
            encoder_engine=at(self.encoder_engine, "encoder", encoder),
            decoder_init_engine=at(self.decoder_init_engine, "decoder_init", encoder),
            decoder_past_engine=at(self.decoder_past_engine, "decoder_with_past", encoder),
            det_engine=at(self.det_engine, "dbnet", "" if self.det_precision == "fp16" else f"_{self.det_precision}"),
            rec_engine=at(self.rec_engine, "crnn", rec),
        )

    def engines(self) -> dict[str, str]:
        """Paths of engine files by the name of their setting."""
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name.endswith("_engine") and getattr(self, f.name)}

    def environment(self) -> dict[str, str]:
        """Switches as environment text."""
        return {"FORMULA_ENABLE": str(self.formulas), "TABLE_ENABLE": str(self.tables)}
