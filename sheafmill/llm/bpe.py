"""Byte-level BPE by a monoid tree: halves are encoded by themselves and then joined.

A text is halved down to leaves of `LEAF` characters, which are encoded directly. Two neighbours
are joined by encoding a window around their border again and keeping all tokens outside of it.
The window reaches on either side to a place where the tokens outside provably don't change:

* Between pieces. The split pattern always ends a match where a letter, digit or other solid
  character is followed by white space, whatever stands further left or right (no alternative
  spans such a border, and none looks beyond it). The window grows, by doubling, until it holds
  such a border on each side.
* Within one piece, a solid or white run longer than `LONG` characters. There the window is one of
  tokens, and it grows until the token left of it and the window's first, and the window's last
  and the token right of it, encode to themselves as pairs. A sequence of tokens of which each
  adjacent pair encodes to itself is the one encoding of its bytes, so the rest can stay.

Decoding concatenates the tokens' bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

LEAF = 1 << 10
#: A run of solid or of white characters from this length on is split within its pieces.
LONG = 1 << 11
#: Bytes of one piece that are merged directly, and tokens of the first window that joins two such.
PIECE, FIRST_WINDOW = 512, 4
#: Unicode's White_Space; Python's \s has four control characters more.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BORDER = re.compile(rf"[^{_WHITE}](?=[{_WHITE}])")
_RUNS = re.compile(rf"([{_WHITE}]+)|[^{_WHITE}]+")
_LONG_WHITE = re.compile(rf"[{_WHITE}]{{{LONG},}}")

SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encoder and decoder for one rank file and split pattern, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.comma = [b"%d," % rank for rank in range(len(self.bytes_of))]
        self._pairs: dict[tuple[int, int], bool] = {}

    # -- texts -----------------------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; those of the tiktoken library."""
        if len(text) <= LEAF and not self._has_long_run(text):
            return self.encoding.encode_ordinary(text)
        if not self._has_long_run(text):
            return self._tree(text, 0, len(text))
        ids: list[int] = []
        for part, long in self._parts(text):
            ids += self._long(part) if long else self._tree(part, 0, len(part))
        return ids

    @staticmethod
    def _has_long_run(text: str) -> bool:
        return len(text) >= LONG and (max(map(len, text.split()), default=0) >= LONG or _LONG_WHITE.search(text) is not None)

    @staticmethod
    def _parts(text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at borders, so that each long run is in a part of its own, which begins
        with the white space before it and ends with the solid run after it."""
        done, white = 0, None
        for run in _RUNS.finditer(text):
            if run[1]:
                white = run
                continue
            at = white.start() if white else run.start()
            white = None
            if run.end() - run.start() >= LONG or run.start() - at >= LONG:
                if at > done:
                    yield text[done:at], False
                yield text[at : run.end()], True
                done = run.end()
        last = white.start() if white and white.end() - white.start() >= LONG else len(text)
        if last > done:
            yield text[done:last], False
        if last < len(text):
            yield text[last:], True

    def _tree(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= LEAF:
            return self.encoding.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        reach = 32
        while True:
            a, b = max(lo, mid - reach), min(hi, mid + reach)
            ends = [m.end() for m in _BORDER.finditer(text, a, min(b + 1, hi))]
            # a border strictly left of mid has its white character in the left half as well
            start = max((e for e in ends if e < mid), default=lo if a == lo else None)
            end = min((e for e in ends if e > mid), default=hi if b == hi else None)
            if start is not None and end is not None:
                break
            reach *= 2
        keep, cut = len(left), len(text[start:mid].encode())
        while cut > 0:
            keep -= 1
            cut -= len(self.bytes_of[left[keep]])
        drop, cut = 0, len(text[mid:end].encode())
        while cut > 0:
            cut -= len(self.bytes_of[right[drop]])
            drop += 1
        left[keep:] = self.encoding.encode_ordinary(text[start:end])
        left += right[drop:] if drop else right
        return left

    # -- pieces ----------------------------------------------------------------------------

    def _long(self, text: str) -> list[int]:
        ids: list[int] = []
        for match in self.split.finditer(text):
            piece = match[0].encode()
            rank = self.ranks.get(piece)
            ids += [rank] if rank is not None else self._merge(piece)
        return ids

    def _merge(self, piece: bytes) -> list[int]:
        if len(piece) <= PIECE:
            return self.encoding._encode_single_piece(piece)
        mid = len(piece) // 2
        left, right = self._merge(piece[:mid]), self._merge(piece[mid:])
        window = FIRST_WINDOW
        while True:
            keep, drop = max(0, len(left) - window), min(len(right), window)
            middle = self._bytes(left[keep:]) + self._bytes(right[:drop])
            again = self.encoding._encode_single_piece(middle)
            if (keep == 0 or self._stable(left[keep - 1], again[0])) and (drop == len(right) or self._stable(again[-1], right[drop])):
                return left[:keep] + again + right[drop:]
            window *= 2

    def _stable(self, a: int, b: int) -> bool:
        """Whether the bytes of the two tokens encode to just these two."""
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) > 1 << 18:
                self._pairs.clear()
            found = self._pairs[a, b] = self.encoding._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    # -- decoding --------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids: leaves of LEAF ids, concatenated up the tree, level by level."""
        level = [self._bytes(ids[at : at + LEAF]) for at in range(0, len(ids), LEAF)] or [b""]
        while len(level) > 1:
            level = [b"".join(level[at : at + 2]) for at in range(0, len(level), 2)]
        return level[0]

    def digest(self, ids: list[int]) -> str:
        """SHA-256 of the decimal ids joined by commas."""
        return hashlib.sha256(b"".join(map(self.comma.__getitem__, ids))[:-1]).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    with open(path, "rb") as lines:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def tokenize(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and `ids array<int>` of each text, encoded whole.

    A null text counts as empty and has no ids; ids stay as they are, null and repeated ones too; an
    empty table gives an empty result; other columns of `docs` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in text_batches(batches, "text"):
            ids = [own.encode(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "ids": _lists(ids)})

    return _over(docs, id_col, text_col, run, "ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id_col, n_tokens, the digest of the ids and the digest of the bytes decoded from them; with
    `with_ids` also the ids.

    Nulls, empty texts and repeated rows: as `tokenize`. The digests are taken where the ids are
    made, so decoded texts don't leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in text_batches(batches, "text"):
            counts, digests, decoded, kept = [], [], [], []
            for text in batch.column("text"):
                ids = own.encode(text.as_py() or "")
                counts.append(len(ids))
                digests.append(own.digest(ids))
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(np.array(ids, np.int32))
            columns = {"id": batch.column("id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": _lists(kept)} if with_ids else {}))

    return _over(docs, id_col, text_col, run, SCHEMA + ", ids array<int>" * with_ids)


def decode_ids(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and `text` of each list of ids; null ids give the empty text, and bytes that aren't
    UTF-8 the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [own.decode(ids or []).decode(errors="replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "text": pa.array(texts, pa.string())})

    pair = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return pair.mapInArrow(run, f"id {pair.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def _lists(ids: list[list[int]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def _over(docs: DataFrame, id_col: str, text_col: str, run, columns: str) -> DataFrame:
    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return pair.mapInArrow(run, f"id {pair.schema['id'].dataType.simpleString()}, {columns}").withColumnRenamed("id", id_col)
