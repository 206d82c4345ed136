"""One query per operator, each over its whole table.

Those without an SQL form need hashes, tokenizers or trained models that DuckDB has not;
``tests/llm`` holds each of them against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from presssignal.llm import (
    bitsliced,
    count_rtree,
    fingerprints,
    hmm,
    idcoder,
    licenses,
    merkle,
    mixing,
    near_dedup,
    packing,
    pivots,
    quality_crf,
    warc,
)
from presssignal.llm.registry import ORACLES, query
from presssignal.llm.support import table
from presssignal.llm.tokens import read_tokenizer


@query
def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"))


@query
def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer)


@query
def op6_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


@query
def op7_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


ORACLES["op7_chunked_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
    max(page_id) OVER (PARTITION BY html) AS owner FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN owner END AS refers_to
FROM d
"""


@query
def op8_context_mixing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    return idcoder.code_documents(table(spark, sf_dir, "documents"), tokenizer)


@query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rtree.jaccard_join(table(spark, sf_dir, "documents"))


ORACLES["op11_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(list_transform(
    range(1, greatest(len(words) - 3, 1) + 1), lambda i: array_to_string(list_slice(words, i, i + 3), ' '))) AS shingle
  FROM w WHERE len(words) > 0
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), link AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), ends AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, ends.b FROM reach r JOIN ends ON ends.a = r.other
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents")).drop("lang", "number", "tampered")


def _leaf(n_chars: str) -> str:
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER () AS r, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS leaf,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(
      range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
        lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 7 = 0 AS tampered
  FROM documents
), leaves AS MATERIALIZED (
  SELECT r, doc_id, tree, leaf, CASE WHEN tampered THEN {_leaf("n_chars + 1")} ELSE leaf END AS other,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS number, count(*) OVER (PARTITION BY tree) AS m
  FROM d
), nodes AS (
  SELECT tree, 0 AS level, number AS place, leaf AS digest, m FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(m) + 1) // 2
  FROM nodes WHERE m > 1 GROUP BY tree, level, place // 2
), subroots AS MATERIALIZED (
  SELECT tree, level AS height, digest, row_number() OVER (ORDER BY tree) - 1 AS number, count(*) OVER () AS m FROM nodes WHERE m = 1
), upper AS (
  SELECT 0 AS level, number AS place, digest, m FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(m) + 1) // 2
  FROM upper WHERE m > 1 GROUP BY level, place // 2
), top AS (SELECT level AS height, digest AS root FROM upper WHERE m = 1),
steps AS MATERIALIZED (
  SELECT l.r, n.level AS step, n.place < l.number >> n.level AS before, n.digest
  FROM leaves l JOIN nodes n ON n.tree = l.tree AND n.m > 1 AND n.place = xor(l.number >> n.level, 1)
  UNION ALL
  SELECT l.r, s.height + u.level, u.place < s.number >> u.level, u.digest
  FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN upper u ON u.m > 1 AND u.place = xor(s.number >> u.level, 1)
), fold AS (
  SELECT r, 0 AS step, other AS digest, s.height + (SELECT height FROM top) AS height FROM leaves l JOIN subroots s ON s.tree = l.tree
  UNION ALL
  SELECT f.r, f.step + 1, sha256(CASE WHEN s.before THEN s.digest || f.digest ELSE f.digest || coalesce(s.digest, '') END), f.height
  FROM fold f LEFT JOIN steps s ON s.r = f.r AND s.step = f.step WHERE f.step < f.height
), proof AS (SELECT r, string_agg(digest, '' ORDER BY step) AS joined FROM steps GROUP BY r)
SELECT l.doc_id, l.leaf, s.digest AS subroot, top.root, sha256(coalesce(p.joined, '')) AS proof_sha256,
  f.digest AS folded_root, f.digest = top.root AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree CROSS JOIN top JOIN fold f ON f.r = l.r AND f.step = f.height LEFT JOIN proof p ON p.r = l.r
"""


@query
def op13_pivot_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.compress(table(spark, sf_dir, "embeddings")).drop("label")


def _assigned(number: int) -> str:
    return f"""a{number} AS MATERIALIZED (
  SELECT p.r, p.part, p.x, min(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) ** 2))::HUGEINT * 256 + b.entry) AS best
  FROM parts p JOIN b{number} b ON b.part = p.part GROUP BY ALL
)"""


def _moved(number: int) -> str:
    return f"""c{number} AS (
  SELECT part, (best % 256)::INT AS entry, place, sum(v)::BIGINT AS s, count(*) AS c FROM (
    SELECT part, best, unnest(x) AS v, unnest(range(len(x))) AS place FROM a{number}) GROUP BY ALL
), b{number + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{number} b LEFT JOIN (
    SELECT part, entry, list((s - (s % c + c) % c) // c ORDER BY place) AS x FROM c{number} GROUP BY ALL
  ) m ON m.part = b.part AND m.entry = b.entry
)"""


_ROUNDS = ",\n".join(f"{_assigned(i)},\n{_moved(i)}" for i in range(pivots.ROUNDS))

ORACLES["op13_pivot_codes"] = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS entry,
    list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, entry, p AS part, list_slice(q, p * (len(q) // 4) + 1, (p + 1) * (len(q) // 4)) AS x FROM v CROSS JOIN range(4) t(p)
), b0 AS MATERIALIZED (SELECT part, entry, x FROM parts WHERE entry < 256),
{_ROUNDS},
{_assigned(pivots.ROUNDS)},
books AS (
  SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (
    SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS place FROM b{pivots.ROUNDS})
), coded AS (
  SELECT r, string_agg(printf('%02x', (best % 256)::INT), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error
  FROM a{pivots.ROUNDS} GROUP BY r
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN v USING (r) CROSS JOIN books
"""
