import random

import numpy as np
import pyarrow as pa
import pytest

from sheafmill.llm import near_dedup
from sheafmill.llm.common import utf8


def words(text):
    out = [""]
    for c in text or "":
        if c in "\t\n\x0b\x0c\r ":
            out.append("")
        else:
            out[-1] += c.lower() if "A" <= c <= "Z" else c
    return [w for w in out if w]


def shingle_set(text):
    w = words(text)
    return {" ".join(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {" ".join(w)} if w else set()


def expected(rows):
    """Components by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    lead = list(range(len(rows)))

    def root(k):
        while lead[k] != k:
            k = lead[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * len(sets[i] | sets[j]):
                lead[root(i)] = root(j)
    smallest = {}
    for k, (doc, _) in enumerate(rows):
        smallest[root(k)] = min(doc, smallest.get(root(k), doc))
    classes = set(map(frozenset, sets))
    near = lambda s: sum(s != t and bool(s) and 100 * len(s & t) >= 85 * len(s | t) for t in classes)
    return {doc: (len(sets[k]), smallest[root(k)], doc == smallest[root(k)], near(sets[k])) for k, (doc, _) in enumerate(rows)}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)] + ["Été", "ÀB", "x#y"]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 9)):
            new = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in new)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1])
def test_equals_all_pairs(spark, seed, tmp_path):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, size int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept, r.n_links) for r in near_dedup.find(docs, folder=f"{tmp_path}/f").collect()}
    assert got == expected(rows)


def test_blocks_split_a_hot_bucket(spark, tmp_path, monkeypatch):
    """Chains of near copies, of which no one is like all, in buckets of more than one block."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 900)
    base, rows = [f"v{k}" for k in range(150)], []
    for k in range(40):
        rows.append((1000 - k, " ".join(base)))
        base[(k * 3) % 150] = f"n{k}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept, r.n_links) for r in near_dedup.find(docs, folder=f"{tmp_path}/f").collect()}
    assert got == expected(rows)


def test_defined_results(spark, tmp_path):
    rows = [(5, "a b c d"), (5, "a b c d"), (4, "A B C D"), (None, "a b c d"), (7, None), (8, ""), (9, " \n"), (10, "one"), (11, "one"), (12, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near_dedup.find(docs, folder=f"{tmp_path}/a").collect())
    assert got == sorted([(5, 2, 4, False)] * 2 + [(4, 2, 4, True), (-1, 2, -1, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False), (12, 1, 12, True)])
    assert near_dedup.find(docs.limit(0), folder=f"{tmp_path}/b").count() == 0
    kept = near_dedup.deduplicated(spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (2, "a b c", "y"), (None, "a b c", "z")], "doc_id long, text string, class string"), folder=f"{tmp_path}/c")
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [(1, "a b c", "x"), (None, "a b c", "z")]))


def test_common_members_of_all_pairs(monkeypatch):
    monkeypatch.setattr(near_dedup, "_COLUMNS", 16)
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (0, 1, 40, 200, 500, 90)]
    got = near_dedup._common(sets, sets[2:])
    assert got.tolist() == [[len(set(a) & set(b)) for b in sets[2:]] for a in sets]
    assert near_dedup._common(sets[:1], sets[:1]).tolist() == [[0]]


def test_a_stray_in_a_hot_bucket_costs_a_comparison_a_member(spark, monkeypatch):
    """Members of one component aren't compared with each other again."""
    n = 5000
    members = spark.range(n + 2).selectExpr("7L AS key", "id")
    marks = spark.range(n + 2).selectExpr("id", "100L AS size", "cast(repeat('a', 64) AS binary) AS sketch")
    comps = spark.range(1, n).selectExpr("id", "0L AS comp")
    groups = near_dedup.rest_pairs(members, marks, comps, "bigint")
    assert groups.count() == 2 * n + 1  # all sketches are equal, so every pair compared is a pair found


def test_repeated_ids_keep_their_own_sets(spark, tmp_path):
    base = [f"w{k}" for k in range(200)]
    near = " ".join([*base[:100], "new", *base[101:]])
    rows = [(5, " ".join(base))] * 30 + [(5, "quite another text of its own")] * 30 + [(6, near), (7, " ".join([*base[:50], "x", *base[51:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.find(docs, folder=f"{tmp_path}/f").distinct().collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in found) == [(5, 5, 0), (5, 5, 2), (6, 5, 2), (7, 5, 2)]
    assert near_dedup.deduplicated(docs, folder=f"{tmp_path}/g").count() == 1
    assert sorted(map(tuple, near_dedup.links(docs, folder=f"{tmp_path}/h").collect())) == [(5, 6), (5, 7), (6, 7)]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    for share in (0.7, 0.85, 0.95):
        gaps = []
        for _ in range(40):
            common = rng.integers(0, 1 << 62, int(1000 * share)).astype(np.uint64)
            rest = (1000 - len(common)) // 2
            sets = [np.concatenate([common, rng.integers(0, 1 << 62, rest).astype(np.uint64)]) for _ in "ab"]
            mins = near_dedup.samples(np.concatenate(sets), np.array([0, len(sets[0]), 2 * len(sets[0])]))
            marks = near_dedup.odd_sketches(mins)
            gaps.append(near_dedup.estimate(marks[:1], marks[1:])[0] - share)
        # what sampling and sketching scatter together at 0.7, where both are widest
        assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.05
        assert share < 0.85 or min(gaps) + share > near_dedup.SKETCH_LEAST


def test_shingles_of_a_very_long_text():
    text = " ".join(f"t{k % 70_000}" for k in range(200_000))
    hashes, bounds = near_dedup.shingles(*utf8(pa.array([text, None, "a"])))
    assert np.diff(bounds).tolist() == [70_000, 0, 1]


def test_components_of_chains_and_hubs(spark, tmp_path):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 60)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    found = near_dedup.components(spark.createDataFrame(edges, "a long, b long"), f"{tmp_path}/c")
    got = {r.id: r.comp for r in found.collect()}
    lead = {}
    root = lambda x: x if lead.get(x, x) == x else root(lead[x])
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        lead[y] = x
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long"), f"{tmp_path}/d").count() == 0


def test_links_hold_every_pair_of_a_group(spark, tmp_path):
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join([*base[: 10 * k], f"new{k}", *base[10 * k + 1 :]])) for k in range(1, 13)]
    rows += [(20, rows[0][1]), (21, "some other text of its own"), (22, None)]  # equal to the first; alone; empty
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.a, r.b) for r in near_dedup.links(docs, folder=f"{tmp_path}/l").collect()}
    assert got == {(a, b) for a in range(1, 13) for b in range(a + 1, 13)}
