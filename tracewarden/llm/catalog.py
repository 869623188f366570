"""The queries of the text operators, each over its whole table, and their SQL twins where SQL can say them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import (
    centroid_clusters, extraction, imatch, large_item_packing, lexical_search, mixing, multi_index, packing, simhash, suffix_dedup, token_store,
    toxicity, url_filter,
)
from tracewarden.llm.common import table
from tracewarden.session import scratch_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
VOCABULARY, END_ID, PACK_END_ID = "word_bpe_49k.json", 1, 2


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query()
def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), folder, vocabulary_path(), END_ID)
    return token_store.read_digests(spark, folder)


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(), PACK_END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"))


@query()
def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return imatch.compare_with_edit(docs, imatch.build_lexicon(docs))


@query()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


@query("""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source),
sums AS (SELECT sum(size) AS all_size, CAST(count(*) FILTER (WHERE size > 0) AS DOUBLE) AS all_weight FROM sizes),
rates AS (
  SELECT source, CASE WHEN size > 0 THEN all_size * 1.0 / (all_weight * size) ELSE 1.0 END AS rate FROM sizes, sums),
parts AS (SELECT source, rate, greatest(CAST(ceil(rate / 16.0) AS INTEGER), 1) AS parts FROM rates),
terms AS (
  SELECT source, rate / parts AS part_rate, 0 AS k, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS c FROM parts
  UNION ALL
  SELECT source, part_rate, k + 1, p * part_rate / (k + 1), c + p * part_rate / (k + 1) FROM terms WHERE k < 80),
cells AS (
  SELECT source, k, lag(c, 1, -1.0) OVER (PARTITION BY source ORDER BY k) AS low, CASE WHEN k = 80 THEN 2.0 ELSE c END AS high FROM terms),
draws AS (
  SELECT d.doc_id, d.source, p.rate, i.i,
         (CAST('0x' || substr(md5('42|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || '|' || i.i), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u, d.row_no
  FROM (SELECT doc_id, source, row_number() OVER () AS row_no FROM documents) d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, p.parts + 1)) AS i(i)),
counts AS (
  SELECT w.doc_id, w.source, w.rate, sum(c.k) AS n
  FROM draws w JOIN cells c ON w.source IS NOT DISTINCT FROM c.source AND w.u > c.low AND w.u <= c.high
  GROUP BY w.row_no, w.doc_id, w.source, w.rate)
SELECT doc_id, source, rate, copy, md5('order|42|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || copy) AS shuffle_key
FROM counts, unnest(range(1, CAST(n AS BIGINT) + 1)) AS r(copy)""")
def op8_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.replicate(docs.select("doc_id", "source"), mixing.rates(docs))
    return mixed.select("doc_id", "source", "rate", "copy", "shuffle_key").orderBy("shuffle_key", "doc_id", "copy")


@query()
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


@query("""
WITH words AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sizes AS (SELECT row_no, doc_id, CAST(len(terms) AS BIGINT) AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
postings AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(terms) AS term FROM words) GROUP BY row_no, term),
asked AS (
  SELECT DISTINCT item_no, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS item_no FROM benchmark)),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
scores AS (
  SELECT a.item_no, a.item_id, s.row_no, s.doc_id,
         CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * s.n * t.docs) // t.terms)))) AS BIGINT) AS score
  FROM asked a JOIN postings p USING (term) JOIN weights w USING (term) JOIN sizes s ON p.row_no = s.row_no, totals t
  GROUP BY a.item_no, a.item_id, s.row_no, s.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50""")
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_large_item_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = large_item_packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(), END_ID)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def _round_sql(before: str, number: int) -> str:
    """One round of assignment to the centroids ``before`` and their new means."""
    return f"""
a{number} AS MATERIALIZED (
  SELECT row_no, arg_min(c, (distance, c)) AS c, min(distance) AS distance
  FROM (SELECT v.row_no, m.c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - m.x[i]) * (v.x[i] - m.x[i]))) AS distance FROM vectors v, {before} m)
  GROUP BY row_no),
m{number} AS MATERIALIZED (
  SELECT c, coalesce(moved, x) AS x FROM {before} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS moved
    FROM (SELECT a.c, i, CAST(sum(v.x[i]) AS BIGINT) AS s, count(*) AS n FROM a{number} a JOIN vectors v USING (row_no), range(1, 65) r(i) GROUP BY a.c, i)
    GROUP BY c) USING (c)),"""


@query("""
WITH numbered AS (SELECT *, row_number() OVER () AS row_no FROM embeddings),
vectors AS MATERIALIZED (
  SELECT row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS x FROM numbered
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), row_no) - 1 AS c, x FROM vectors
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), row_no) <= 16),"""
       + _round_sql("m0", 1) + _round_sql("m1", 2) + _round_sql("m2", 3) + _round_sql("m3", 4) + """
sums AS (SELECT c, CAST(sum(distance) AS BIGINT) AS own, CAST(sum(sum(distance)) OVER () AS BIGINT) AS total FROM a4 GROUP BY c)
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance, s.own AS cluster_inertia, s.total AS inertia,
       sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a4 a JOIN vectors v USING (row_no) JOIN sums s ON a.c = s.c JOIN m3 m ON a.c = m.c""")
def op13_equal_average_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster(table(spark, sf_dir, "embeddings"))
