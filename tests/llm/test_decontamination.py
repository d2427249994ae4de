import random

from sheafmill.llm import decontamination
from tests.llm.test_near_dedup import shingle_set, words


def expected(docs, items):
    out = []
    for doc, text in docs:
        w = words(text)
        runs = {size: {" ".join(w[k : k + size]) for k in range(len(w) - size + 1)} for size in (1, 2, 3)}
        for item, passage in items:
            wanted = shingle_set(passage)
            own = runs[min(3, max(1, len(words(passage))))]
            if wanted and 100 * len(wanted & own) >= 70 * len(wanted):
                out.append((doc, item, len(wanted & own), len(wanted)))
    return sorted(map(repr, out))


def rows_of(frame):
    return sorted(repr((r.doc_id, r.item_id, r.n_shared, r.item_size)) for r in frame.collect())


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghij") + rng.choice("abcdefghij") + rng.choice("xyz")
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 9, 20, 50, 90])))) for k in range(40)]
    docs = []
    for k in range(120):
        parts = [word() for _ in range(rng.choice([0, 5, 60, 900]))]
        if rng.random() < 0.6:
            passage = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                passage[rng.randrange(len(passage))] = word()
            at = rng.randint(0, len(parts))
            parts[at:at] = [w.upper() for w in passage] if rng.random() < 0.3 else passage
        docs.append((k, "\n".join(parts)))
    frame = spark.createDataFrame([(d, t, 0, "h") for d, t in docs], "doc_id long, text string, size int, hash string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.search(frame, bench, folder=f"{tmp_path}/a")
    want = expected(docs, items)
    assert rows_of(found) == want and want
    dirty = {r.doc_id for r in found.collect()}
    clean = decontamination.cleaned(frame, bench, folder=f"{tmp_path}/b", min_words=1)
    assert clean.columns == frame.columns
    assert sorted(r.doc_id for r in clean.collect()) == [d for d, _ in docs if d not in dirty]
    long = {d for d, i in ((r.doc_id, r.item_id) for r in found.collect()) if len(items[i][1].split()) >= 3}
    assert dirty > long
    clean = decontamination.cleaned(frame, bench, folder=f"{tmp_path}/c")
    assert sorted(r.doc_id for r in clean.collect()) == [d for d, _ in docs if d not in long]


def test_a_very_long_text(spark, tmp_path):
    passage = " ".join(f"p{k}" for k in range(40))
    long = " ".join(f"w{k % 9000}" for k in range(250_000))
    docs = spark.createDataFrame([(1, f"{long} {passage} {long}"), (2, long), (3, "t" * 1_000_000)], "doc_id long, text string")
    found = decontamination.search(docs, spark.createDataFrame([(9, passage)], "item_id long, text string"), folder=f"{tmp_path}/a")
    assert rows_of(found) == [repr((1, 9, 38, 38))]


def test_defined_results(spark, tmp_path):
    passage = "one two three four five six"
    docs = spark.createDataFrame([(1, passage), (1, passage), (None, f"x {passage}"), (2, None), (3, ""), (4, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage), (7, passage), (None, passage), (8, None), (9, ""), (10, "one two")], "item_id long, text string")
    found = decontamination.search(docs, items, folder=f"{tmp_path}/a")
    short = [(d, 10, 1, 1) for d in (1, None, 4)]  # two words, found wherever they stand side by side
    assert rows_of(found) == sorted(map(repr, [(d, i, 4, 4) for d in (1, None) for i in (7, None)] + short))
    clean = decontamination.cleaned(docs, items, folder=f"{tmp_path}/b")
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3, 4]
    assert decontamination.search(docs.limit(0), items, folder=f"{tmp_path}/c").count() == 0
    assert decontamination.search(docs, items.limit(0), folder=f"{tmp_path}/d").count() == 0
    assert decontamination.cleaned(docs, items.limit(0), folder=f"{tmp_path}/e").count() == 6


def test_needed_hits_lose_nothing_at_the_limit():
    assert decontamination.needed(1) == 1 and decontamination.needed(13) >= 9
    for partition in range(0, 12):
        assert 1 <= decontamination.needed_by_partition(partition) <= decontamination.SAMPLES
