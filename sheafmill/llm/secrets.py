"""Secret scans with multipart credential linking.

Strong spans (assigned values, access identifiers, long hexadecimal runs) are reported wherever
they stand. Weak parts, an account identifier, a secret-looking value or an endpoint, are common in
harmless text and reported only where parts complete each other: each part is joined to the scope,
a paragraph, whose interval holds it, and a scope is a finding if it holds a secret together with an
identifier or an endpoint. Strong spans take part in the join as identifiers and secrets.

Text and offsets are those of the whole text, so there is no shuffle: the join runs over the spans of
one text at a time, with a binary search per span in the scopes and in the running maximum of the
strong spans' ends.

Defined results: null and empty texts have no spans; ids may be null or repeated, every row is
scanned by itself; an empty table gives an empty result; texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 6, 20, 24

Span = tuple[int, int, int]  # start, kind, end

# A lower-cased copy is searched, which for bytes changes A-Z alone and keeps all places.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4))
_HEX = re.compile(rb"[0-9a-f]{%d,}" % MIN_HEX)
_WEAK = (
    (3, re.compile(rb"""(?:user(?:name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?|tenant)["']?\x20*[:=]\x20*["']?([a-z0-9_.@-]{3,})""")),
    (4, re.compile(rb"""(?:pwd|pass|private_?key|access_?key_?secret|client_?key|credential|auth)["']?\x20*[:=]\x20*["']?([^\s"']{6,})""")),
    (5, re.compile(rb"""(?:[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|(?:host(?:name)?|endpoint|server|bucket)["']?\x20*[:=]\x20*["']?[a-z0-9.:/_-]{3,})""")),
)
#: Any weak part has one of these; most texts have none and skip the weak patterns.
_HINT = re.compile(rb"://|[:=]")
_SCOPE_END = re.compile(rb"\n[ \t\r]*\n")


def base_spans(text: bytes) -> list[Span]:
    """Strong spans in bytes, sorted."""
    lower = text.lower()
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(lower) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def linked_spans(text: bytes, strong: list[Span]) -> list[Span]:
    """Weak parts, in bytes, of the scopes in which a secret meets an identifier or an endpoint."""
    if not _HINT.search(text):
        return []
    lower = text.lower()
    weak = [(m.start(), kind, m.end()) for kind, pattern in _WEAK for m in pattern.finditer(lower)]
    if not weak:
        return []
    cuts = [m.end() for m in _SCOPE_END.finditer(text)]
    roles: dict[int, set[str]] = {}
    for start, kind, _ in strong + weak:
        role = "endpoint" if kind == 5 else "identifier" if kind in (1, 3) else "secret"
        roles.setdefault(bisect_right(cuts, start), set()).add(role)
    complete = {scope for scope, has in roles.items() if "secret" in has and len(has) > 1}
    starts, ends = [a for a, _, _ in strong], list(accumulate((b for _, _, b in strong), max))
    # inside of a strong span is what ends before one that doesn't begin later
    inside = lambda a, b: (k := bisect_right(starts, a)) > 0 and b <= ends[k - 1]
    return [s for s in weak if bisect_right(cuts, s[0]) in complete and not inside(s[0], s[2])]


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Strong and linked spans, in code points with exclusive ends."""
    raw = (text or "").encode()
    strong = base_spans(raw)
    linked = linked_spans(raw, strong)
    if not strong and not linked or raw.isascii():
        return strong, linked
    # places in code points: one pass over the text between the sorted byte places
    places, at, count = {}, 0, 0
    for place in sorted({p for s in strong + linked for p in (s[0], s[2])}):
        count += len(raw[at:place].decode(errors="ignore"))
        places[place], at = count, place
    return [(places[a], k, places[b]) for a, k, b in strong], [(places[a], k, places[b]) for a, k, b in linked]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the numbers of strong spans by kind, base_sha256 of these, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for text in batch.column("text"):
                strong, linked = find(text.as_py())
                for kind in range(3):
                    out[kind].append(sum(k == kind for _, k, _ in strong))
                base = _joined(strong)
                out[3].append(hashlib.sha256(base.encode()).hexdigest())
                out[4].append(_joined(sorted(strong + linked)) if linked else base)
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, t) for x, t in zip(out, types))], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return pair.mapInArrow(run, f"id {pair.schema['id'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("id", id_col)


def redact(text: str | None) -> str | None:
    """The text with every span, strong or linked, replaced by its kind in brackets; overlapping
    spans are one replacement, named after the first."""
    strong, linked = find(text)
    if not strong and not linked:
        return text
    parts, at, last = [], 0, None
    for start, kind, end in sorted(strong + linked):
        if last is not None and start < at:
            at = max(at, end)
            continue
        parts += [text[at:start], f"[{KINDS[kind]}]"]
        at, last = end, kind
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of `docs` with their texts redacted, and length_col, if it is there and an
    integer, as the new length in code points; rows without a span, null texts included, stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, text_col):
            texts = batch.column(text_col)
            new = [redact(t) for t in texts.to_pylist()]
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns[text_col] = pa.array(new, texts.type)
            if length_col in columns and pa.types.is_integer(columns[length_col].type):
                old = columns[length_col]
                lengths = [len(b) if a != b else c for a, b, c in zip(texts.to_pylist(), new, old.to_pylist())]
                columns[length_col] = pa.array(lengths, old.type)
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, docs.schema)
