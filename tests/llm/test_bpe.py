import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

from sheafmill.llm import bpe, files, token_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
EOD = 50256


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECES = ["a", "b", " ", "  ", "\n", "1", "'s", "é", "日本", "　", "\x1f", "!", "??", "\t", "x" * 50, "ab" * 40, "\x85", "  \n ", "😀", "12345", "don't"]


def test_tree_equals_the_library(plain, monkeypatch):
    """Leaves and pieces are made small, so that short texts take every path of the tree."""
    import re

    monkeypatch.setattr(bpe, "LEAF", 16)
    monkeypatch.setattr(bpe, "LONG", 24)
    monkeypatch.setattr(bpe, "PIECE", 16)
    monkeypatch.setattr(bpe, "_LONG_WHITE", re.compile(rf"[{bpe._WHITE}]{{24,}}"))
    own, rng = bpe.codec(PATH, PATTERN), random.Random(7)
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.3:
            text += " " * rng.randint(0, 60) + text
        assert own.encode(text) == plain.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", "word " * 60_000, "a" * 200_000, " " * 50_000 + "b", "ab" * 50_000 + "\n" * 5000, "日本語" * 20_000])
def test_very_long_texts(plain, text):
    own = bpe.codec(PATH, PATTERN)
    ids = own.encode(text)
    assert own.decode(ids) == text.encode()
    assert ids == plain.encode_ordinary(text)


def test_texts_of_a_table_equal_the_library(plain):
    """Most texts are longer than a leaf, so the tree encodes them."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    own = bpe.codec(PATH, PATTERN)
    assert sum(len(t) > bpe.LEAF for t in texts) > len(texts) / 2
    assert all(own.encode(t) == plain.encode_ordinary(t) for t in texts)


def test_round_trip_rows(spark, plain):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (None, "é" * 9, "y"), (3, None, "z"), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.round_trip(docs, PATH, PATTERN, with_ids=True).collect()
    want = []
    for doc, text, _ in rows:
        ids = plain.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.round_trip(docs.limit(0), PATH, PATTERN).count() == 0
    back = bpe.decode_ids(bpe.tokenize(docs, PATH, PATTERN), PATH, PATTERN)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t, _ in rows)


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rng, want = np.random.default_rng(1), []
    names = []
    for k, sizes in enumerate([[3, 0, 7, 1], [], [0], [50], [5, 4]]):
        name = f"file://{tmp_path}/{k}.tokens"
        tokens = np.concatenate([np.zeros(0, int), *(np.append(rng.integers(0, 99, n), EOD) for n in sizes)])
        if k == 4:
            tokens = tokens[:-1]  # the last document has no end
        with files.opened(name, "w") as out:
            out.write(tokens.astype("<u2").tobytes())
        at = 0
        for ordinal, n in enumerate(sizes):
            want.append((name, ordinal, at, n, not (k == 4 and ordinal == 1)))
            at += n + 1
        names.append((name,))
    got = token_counts.scan(spark.createDataFrame(names, "file string"), EOD, block_bytes=block)
    assert sorted(map(tuple, got.select("file", "ordinal", "start", "n_tokens", "terminated").collect())) == sorted(want)
    assert token_counts.scan(spark.createDataFrame([], "file string"), EOD).count() == 0


def test_counts_of_written_files(spark, tmp_path, plain):
    rows = [(1, "one two"), (1, "one two"), (None, None), (2, ""), (3, "x " * 40_000)]
    docs = spark.createDataFrame([(*r, "f", 1) for r in rows], "doc_id long, text string, file string, ordinal int")
    placed = token_counts.write_files(docs, f"file://{tmp_path}/t", PATH, PATTERN, EOD)
    placed.write.parquet(f"{tmp_path}/placed")
    placed = spark.read.parquet(f"{tmp_path}/placed")
    counted = placed.join(token_counts.scan(placed.select("file").distinct(), EOD), ["file", "ordinal"])
    assert sorted((r.doc_id or 0, r.n_tokens, r.terminated) for r in counted.collect()) == sorted((d or 0, len(plain.encode_ordinary(t or "")), True) for d, t in rows)
