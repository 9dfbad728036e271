"""The queries of this subpackage and the SQL they are checked against (where SQL can express them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.llm import alignment, debruijn, licenses, line_rules, mil, mixing, ngram_trie, parity_join, parsing, pieces, token_bits, toxicity, webp
from terradelta.llm.common import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op3_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.score(documents(spark, sf_dir))


def op4_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_quality(documents(spark, sf_dir))


def op5_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.edit_digests(pieces.segmented_edits(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model")))


def op6_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.stored_media_features(documents(spark, sf_dir))


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_components(documents(spark, sf_dir))


def op8_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_bits.packed_corpus(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end=2, vocab_size=49_408)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.collocations(documents(spark, sf_dir))


def op12_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.edited_fingerprints(documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM sized GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight, source_size * 2e0 AS cap FROM per),
steps AS (SELECT cap / weight AS ratio, coalesce(sum(cap) OVER before, 0) AS used, coalesce(sum(weight) OVER before, 0) AS gone FROM w
  WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(l, ratio) AS l FROM (SELECT ratio, (1.5e0 * (SELECT sum(source_size) FROM w) - used) / ((SELECT sum(weight) FROM w) - gone) AS l
  FROM steps) WHERE l <= ratio),
targets AS (SELECT source, source_size, least(cap, weight * l) AS target FROM w, level),
runs AS (SELECT s.doc_id, s.size, t.source_size, t.target, sum(s.size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (CASE WHEN source_size = 0 THEN 0 ELSE
  floor(floor(target) / source_size) * size + greatest(0, least(size, floor(target) - floor(floor(target) / source_size) * source_size - before)) END)::BIGINT AS taken
FROM runs"""

JOIN_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g FROM w, unnest(range(1, greatest(2, len(w) - 3))) x(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS found FROM n UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.found)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(found) AS id FROM reach GROUP BY node) c ON c.node = w.doc_id"""

QUERIES = {f.__name__: f for f in (op1_attention_quality, op2_license_scan, op3_ngram_trie, op4_line_cleaning, op5_nbest_pieces, op6_webp_media, op7_parity_join, op8_token_bits, op9_toxicity, op10_source_mix, op11_collocations, op12_consistent_parsing, op13_alignment)}
ORACLES = {"op2_license_scan": licenses.oracle(), "op4_line_cleaning": line_rules.oracle(), "op7_parity_join": JOIN_SQL, "op10_source_mix": MIX_SQL, "op11_collocations": debruijn.oracle()}
