"""One query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from secrets import token_bytes

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, near_dedup, pii, quality_classifier, quality_rules, secrets, token_counts, url_filters, warc
from .common import shared_dir, stored, table

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
#: The vocabulary has ids below 50,256; this one is free and ends a document in token files.
END_OF_DOCUMENT = 50256


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents are written and then scanned; doc_id comes back by place."""
    folder = shared_dir(spark)
    placed = stored(token_counts.write_files(table(spark, sf_dir, "documents"), f"{folder}/tokens", VOCABULARY, PATTERN, END_OF_DOCUMENT), f"{folder}/placed")
    counted = token_counts.scan(placed.select("file").distinct(), END_OF_DOCUMENT)
    # file names compress so well that the table on disk looks small enough to broadcast; it grows with the input
    return placed.hint("merge").join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "terminated")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find(table(spark, sf_dir, "documents"))


#: The setting that holds the pseudonym key; by the word in its name Spark keeps its value out of logs.
PSEUDONYM_KEY = "spark.sheafmill.pseudonym.secret"


@lru_cache(maxsize=1)
def _drawn_key(application: str) -> bytes:
    return token_bytes(32)


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no key is set one is drawn for the application, so that nothing published leads back."""
    key = spark.conf.get(PSEUDONYM_KEY, None)
    own = key.encode() if key else _drawn_key(spark.sparkContext.applicationId)
    return pii.pseudonymised(table(spark, sf_dir, "documents"), own)


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    written = stored(warc.write(warc.deduplicated(table(spark, sf_dir, "pages"), folder=folder), f"{folder}/warc"), f"{folder}/archives")
    return warc.scan(written).drop("url")


URL_RULES = [
    url_filters.Rule("block", "com", "/en/"),
    url_filters.Rule("allow", "example.com", "/en/7"),
    url_filters.Rule("allow", "net", "/de/"),
    url_filters.Rule("block", "example.net", "/de/8"),
    url_filters.Rule("block", "org", "/es/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.judge(docs, quality_rules.fit(docs, trusted))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_token_counts": op2_token_counts,
    "op3_near_dedup": op3_near_dedup,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_url_filter": op6_url_filter,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
}

#: Lists of distinct three-word shingles; with one or two words, of them all.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SHINGLES = "list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])"

ORACLE_SQL: dict[str, str] = {
    "op3_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
             s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE {_SHINGLES} END AS s FROM w),
             n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
             e AS (SELECT doc_id, unnest(s) AS g FROM s),
             c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
             l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
             d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, d.b FROM r JOIN d ON r.other = d.a),
             m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id),
             f AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s),
             q AS (SELECT doc_id, n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM f GROUP BY ALL),
             k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h, n) AS class_id FROM q),
             t AS (SELECT x.class_id, count(*) AS n_links FROM d JOIN k x ON x.doc_id = d.a AND x.class_id = d.a JOIN k y ON y.doc_id = d.b AND y.class_id = d.b GROUP BY ALL)
        SELECT n.doc_id, n.n AS n_shingles, coalesce(k.class_id, n.doc_id) AS class_id, component_id, n.doc_id = component_id AS kept, coalesce(n_links, 0) AS n_links
        FROM n JOIN m USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN t ON t.class_id = k.class_id""",
    "op9_decontamination": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
             v AS (SELECT item_id, {_WORDS} AS w, least(len({_WORDS}), 3) AS k FROM benchmark),
             i AS (SELECT item_id, k, CASE WHEN k < 3 THEN [array_to_string(w, ' ')] ELSE {_SHINGLES} END AS s FROM v WHERE k > 0),
             u AS (SELECT item_id, k, len(s) AS item_size, unnest(s) AS g FROM i),
             e AS (SELECT doc_id, 3 AS k, unnest({_SHINGLES}) AS g FROM w WHERE len(w) >= 3
                   UNION ALL SELECT doc_id, 1, unnest(list_distinct(w)) FROM w WHERE EXISTS (SELECT 1 FROM i WHERE k = 1)
                   UNION ALL SELECT doc_id, 2, unnest(list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) FROM w WHERE EXISTS (SELECT 1 FROM i WHERE k = 2))
        SELECT doc_id, item_id, count(*) AS n_shared, item_size, count(*) / item_size AS containment
        FROM e JOIN u USING (k, g) GROUP BY doc_id, item_id, item_size HAVING 100 * count(*) >= 70 * item_size""",
    "op5_warc_round_trip": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
             d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
             l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM l""",
}
