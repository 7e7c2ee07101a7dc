"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table
from .bpe import digest, encode
from .codes import code_table
from .embeddings import near_vectors
from .exact_dedup import exact_groups
from .html import extract
from .lexical import search
from .lines import line_dedup
from .minhash import near_groups
from .mixing import mix_plan
from .sharding import histogram_shards
from .substrings import substring_digest
from .suffixes import suffix_dedup
from .toxicity import score, train

Query = Callable[[SparkSession, str], DataFrame]


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op1_lines_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), min_words=50).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = histogram_shards(table(spark, sf_dir, "documents"), 40)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(table(spark, sf_dir, "documents"))


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode(table(spark, sf_dir, "documents"), public_tokenizer(), decoded=True))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_table(table(spark, sf_dir, "embeddings"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, pos, [line, lead(line) OVER d, lead(line, 2) OVER d] AS run, lead(pos, 2) OVER d IS NOT NULL AS whole FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM w WHERE whole) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, pos + o AS pos FROM later, (SELECT unnest([0, 1, 2]) AS o)),
kept AS (SELECT l.doc_id, count(*) AS n, count(g.pos) AS removed, string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""

OP1_BY_WORDS_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
w AS (SELECT doc_id, pos, 1 AS k, [line] AS run, words >= CASE WHEN n = 1 THEN 1 ELSE 50 END AS counts FROM c
  UNION ALL SELECT doc_id, pos, 2, [line, lead(line) OVER d], words + lead(words) OVER d >= CASE WHEN n = 2 THEN 1 ELSE 50 END FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
  UNION ALL SELECT doc_id, pos, 3, [line, lead(line) OVER d, lead(line, 2) OVER d], lead(pos, 2) OVER d IS NOT NULL FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, pos, k FROM (SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY doc_id, pos) AS nth FROM w) WHERE nth > 1 AND counts),
gone AS (SELECT DISTINCT doc_id, pos + o AS pos FROM later, (SELECT unnest([0, 1, 2]) AS o) WHERE o < k),
kept AS (SELECT l.doc_id, count(*) AS n, count(g.pos) AS removed, string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""

OP9_SQL = r"""
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT *, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
      FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents))
"""


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
held AS (SELECT doc_id, t, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM held) SEMI JOIN q USING (term) GROUP BY ALL),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM held),
w AS (SELECT term, floor(1000 * ln((2.0 * docs + 2) / (2.0 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, docs),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))) AS impact FROM p JOIN w USING (term), c),
s AS (SELECT item_id, doc_id, sum(times * impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_lines, op1_lines_by_words, op2_sharding, op3_html, op4_embeddings, op5_mixing, op6_substrings, op7_bpe, op8_minhash, op9_exact_dedup, op10_toxicity, op11_suffixes, op12_codes, op13_search)}


def oracle_sql() -> dict[str, str]:
    return {"op1_lines": OP1_SQL, "op1_lines_by_words": OP1_BY_WORDS_SQL, "op9_exact_dedup": OP9_SQL, "op13_search": OP13_SQL}
