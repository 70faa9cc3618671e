"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm import (conversation_trie, decontaminate, jaccard_join, langid, language_model, licenses, merkle, order_minhash, packing, secrets,
                          sharding, store_sql, toxicity, warc_store)
from retentio.llm.common import Scratch, fold, read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learns from the rows outside fold 0."""
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").filter(fold(F.col("doc_id")) != 0)
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every document; learns from the rows outside fold 1."""
    docs = read(spark, sf_dir, "documents")
    scratch = Scratch(spark, "lm")
    held_out = fold(F.col("doc_id")) == 1
    model = language_model.fit(docs, ~held_out, scratch)
    return language_model.score(docs, model, scratch, held_out)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of near equal bytes."""
    return sharding.shard(read(spark, sf_dir, "documents"), 40)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token pieces in sequences of at most 2048 ids."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked at a Jaccard similarity of 0.8 of their 5-word shingles."""
    return jaccard_join.similar(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learns from the rows outside fold 0."""
    docs = read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs.filter(fold(F.col("doc_id")) != 0)))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-sensitive fingerprints of every document and of its half-edited text."""
    return order_minhash.half_edited(read(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = read(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.detect(read(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of the conversations, each rebuilt on the head of the first of its hundred."""
    head = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 6
    return conversation_trie.trie(read(spark, sf_dir, "conversations"), Scratch(spark, "trie"), lambda c: c - c % 100, head)


def op12_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records in a content-addressed archive, read back from it."""
    return warc_store.report(warc_store.write(read(spark, sf_dir, "pages"), Scratch(spark, "warc")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents; half of them are presented without their line ends."""
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0
    claims = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    manifest = merkle.build(read(spark, sf_dir, "documents"), Scratch(spark, "merkle"), claims=claims)
    return merkle.verify(manifest).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_language_model, op3_sharding, op4_packing, op5_decontamination, op6_jaccard_join, op7_language_id,
                                  op8_fingerprints, op9_secret_scan, op10_license_scan, op11_conversation_trie, op12_warc_store, op13_merkle_manifest)}

#: Windows by enumeration: an item's runs of 10 words (or all its words, if fewer) against a document's runs.
OP5_SQL = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS run
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
keyed AS (SELECT row_number() OVER () AS r, doc_id, w FROM folded),
runs AS (
  SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS run
  FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM keyed, sizes)),
hits AS (SELECT runs.r, runs.i, runs.k, win.item FROM runs JOIN win ON runs.k = win.k AND runs.run = win.run),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(found.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AS contaminated
FROM keyed LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""

#: All pairs that share a shingle, and reachability by recursion.
OP6_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM keyed WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
sets AS (SELECT r, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM shingles GROUP BY r),
reps AS (SELECT h, min(r) AS rep FROM sets GROUP BY h),
own AS (SELECT shingles.r, s FROM shingles JOIN reps ON shingles.r = reps.rep),
shared AS (SELECT a.r AS u, b.r AS v, count(*) AS n FROM own a JOIN own b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2),
links AS (SELECT u, v FROM shared JOIN sizes x ON x.r = u JOIN sizes y ON y.r = v
  WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(u, v) AS (SELECT rep, rep FROM reps UNION SELECT reach.u, edges.v FROM reach JOIN edges ON reach.v = edges.u),
member AS (SELECT sets.r, reps.rep FROM sets JOIN reps USING (h)),
least_id AS (SELECT reach.u, min(doc_id) AS component_id FROM reach JOIN member ON member.rep = reach.v
  JOIN keyed ON keyed.r = member.r GROUP BY reach.u)
SELECT doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM keyed LEFT JOIN sizes USING (r) LEFT JOIN member USING (r) LEFT JOIN least_id ON least_id.u = member.rep
"""

ORACLES: dict[str, str] = {"op6_jaccard_join": OP6_SQL, "op5_decontamination": OP5_SQL, **store_sql.ORACLES}
