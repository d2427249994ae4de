import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sheafmill.llm import quality_classifier, quality_rules
from sheafmill.llm.common import utf8

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words, seen, twice = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    count, covered = collections.Counter(grams), set()
    for k, gram in enumerate(grams):
        if count[gram] > 1:
            covered.update(range(k, k + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(covered)


def test_base_counts_equal_plain_ones():
    rng = random.Random(8)
    texts = ["", " ", "\n\n", "a b c d e a b c d e", "x\n x\nx\nx", "é#日本", "a\x0bb\x0cc\x85d e"]
    texts += ["".join(rng.choice(["a", "b ", "\n", "c d e f g ", "é", "#", "|", "\t"]) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts.append("lorem ipsum " * 60_000)
    found = quality_rules.base_columns(*utf8(pa.array(texts)))
    got = list(zip(*(found[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == list(map(plain, texts))


def test_rules_keep_clean_and_reject_junk(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    trusted = labels.where("quality = 1").select("doc_id")
    ratio = quality_rules.fit(docs, trusted)
    judged = quality_rules.judge(docs, ratio)
    rows = judged.join(labels, "doc_id").select("kept", "quality").collect()
    clean, junk = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.1
    kept = quality_rules.keep(docs, ratio)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in judged.where("kept").collect())


def test_rules_defined_results(spark):
    rows = [(1, None, True), (2, "", True), (None, "a b c d e f g h i j", False), (3, "a b c d e f g h i j", None), (3, "a b c d e f g h i j", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    ratio = quality_rules.fit(docs, None)
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in quality_rules.judge(docs, ratio).collect())
    assert got == [(0, 10, False, True), (1, 0, True, False), (2, 0, True, False), (3, 10, False, True), (3, 10, False, True)]
    assert quality_rules.judge(docs.limit(0), quality_rules.fit(docs.limit(0), docs.select("doc_id"))).count() == 0


def test_rules_count_every_trusted_document(spark):
    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat('a document of its own, with number ', hex(id * 7919)) AS text")
    model = quality_rules.fit(docs, docs.select("doc_id"))
    # as all are trusted, both sides are the same counts
    assert quality_rules.judge(docs, model).where("abs(score) > 1e-9").count() == 0


def plain_judgement(docs, trusted):
    """Scores and threshold by counting every gram in dictionaries."""
    grams = lambda t: [t.encode()[k : k + 4] for k in range(len(t.encode()) - 3)]
    raw, target = collections.Counter(), collections.Counter()
    for doc, text in docs:
        raw.update(grams(text or ""))
        if doc in trusted:
            target.update(grams(text or ""))
    share = sum(target.values()) / sum(raw.values())
    score = {}
    for doc, text in docs:
        own = grams(text or "")
        score[doc] = sum(np.log((target[g] + 1) / (raw[g] * share + 1)) for g in own) / (len(own) + quality_rules.PRIOR)
    held = []
    for doc, text in docs:
        if doc in trusted and text:
            own = collections.Counter(grams(text))
            n = sum(own.values())
            part = (sum(target.values()) - n) / sum(raw.values())
            held.append(np.floor(1000 * sum(k * np.log((target[g] - k + 1) / (raw[g] * part + 1)) for g, k in own.items()) / (n + quality_rules.PRIOR)))
    below = [b for b in held if sum(x < b for x in held) <= quality_rules.FALSE_REJECTS * len(held)]
    return score, max(below) / 1000


def test_scores_and_threshold_equal_plain_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    trusted = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    score, threshold = plain_judgement(rows, {r.doc_id for r in trusted.collect()})
    model = quality_rules.fit(docs, trusted)
    assert abs(model.threshold - threshold) < 1e-9
    for r in quality_rules.judge(docs, model).collect():
        assert abs(r.score - score[r.doc_id]) < 1e-9 and r.kept == (not r.base_failed and r.score >= threshold)


def test_rare_grams_share_buckets_in_a_bounded_table(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    trusted = labels.where("quality = 1").select("doc_id")
    whole = quality_rules.fit(docs, trusted)
    small = quality_rules.fit(docs, trusted, most=3000)
    assert len(small.table.keys) <= 3002 < len(whole.table.keys) and small.table.pool == quality_rules.POOL
    rows = quality_rules.judge(docs, small).join(labels, "doc_id").select("kept", "quality").collect()
    clean, junk = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.1
    # trusted ids that are too many to be sent meet the documents by shuffle, to the same end
    monkeypatch.setattr(quality_rules, "BROADCAST_KEYS", 0)
    again = quality_rules.fit(docs, trusted)
    assert again.threshold == whole.threshold and np.allclose(np.sort(again.table.values), np.sort(whole.table.values))


def test_rules_tell_junk_among_many_grams(spark):
    rng = np.random.default_rng(3)
    clean, junk = list("abcdefghijklmnopqrstuvwxyz12345 "), list("ABCDEFGHIJKLMNOPQRSTUVWXYZ67890 ")
    texts = ["".join(rng.choice(letters, 600)) for letters in (clean, junk) for _ in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = quality_rules.fit(docs, docs.where("doc_id < 1000").select("doc_id"))
    assert len(model.table.keys) == 2 + len({t[k : k + 4] for t in texts for k in range(597)}) > 1 << 19
    kept = {r.doc_id for r in quality_rules.judge(docs, model).where("kept").collect()}
    passed = {r.doc_id for r in quality_rules.judge(docs, model).where("not base_failed").collect()}
    assert len(kept & set(range(1000, 2000))) > 0.97 * len(passed & set(range(1000, 2000)))
    assert len(kept & set(range(2000, 4000))) < 0.05 * len(passed & set(range(2000, 4000)))


def test_classifier_on_held_out_rows(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.score(docs, labels, folder=f"{tmp_path}/a").join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97


def test_classifier_ignores_labels_of_the_fold_and_all_but_text(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    changed = docs.selectExpr("doc_id", "text", "'zz' AS lang", "'zz' AS source", "'x' AS features")
    a = {r.doc_id: r.score for r in quality_classifier.score(docs, labels, folder=f"{tmp_path}/a").collect()}
    b = {r.doc_id: r.score for r in quality_classifier.score(changed, turned, folder=f"{tmp_path}/b").collect()}
    assert a == b


def test_classifier_defined_results(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a"), (1, None), (2, ""), (2, ""), (3, "x " * 200_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.score, 6) for r in quality_classifier.score(docs, none, folder=f"{tmp_path}/a").collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (3, 1), (None, 0), (2, None)], "doc_id long, quality int")
    rows = quality_classifier.score(docs, one, folder=f"{tmp_path}/b").collect()
    assert len(rows) == 5 and all(r.score > 0.5 for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
    assert quality_classifier.score(docs.limit(0), one, folder=f"{tmp_path}/c").count() == 0


def test_labels_without_a_document_leave_the_sample_whole(spark):
    """Of many labelled ids few are in the documents: all of these are learnt from."""
    ids = spark.range(40_000).selectExpr("id", "CAST(id % 2 AS int) AS label")
    rows = spark.range(400).selectExpr("id * 100 AS id", "transform(sequence(1, 23), x -> CAST(x * (id % 2) AS float)) AS features")
    known = rows.join(ids, "id").where(~quality_classifier.held_out(F.col("id"))).count()
    seen = []
    quality_classifier_train = quality_classifier.train
    try:
        quality_classifier.train = lambda table, labels: seen.append(len(labels)) or quality_classifier_train(table[:9], labels[:9])
        quality_classifier.fit(rows, ids, train_rows=1000)
        quality_classifier.fit(rows.union(rows).union(rows), ids, train_rows=200)
    finally:
        quality_classifier.train = quality_classifier_train
    assert seen == [known, 200]


def test_table_sums_are_the_score():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(600, len(quality_classifier.FEATURES))).astype(np.float32)
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0)).astype(float)  # an interaction and no main effect
    model = quality_classifier.train(rows, labels)
    assert np.mean((model.score(rows) > 0.5) == labels) > 0.9
    assert (0, 1) in model.pairs
