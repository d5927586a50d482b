"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, fingerprints, language_id, line_dedup, mixing, packing, pii, simhash_dedup, token_counts, toxicity
from .common import id_remainder, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(id_remainder(F.col("doc_id")) != 0))
    held = (id_remainder(F.col("doc_id")) == 0).alias("held_out")
    return language_id.identify(docs, model).select("doc_id", held, "lang_pred", "score", "rejected", "distance")


@query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    learn = id_remainder(F.col("doc_id")) != 0
    model = toxicity.fit(docs.filter(learn), labels.filter(learn))
    held = (id_remainder(F.col("doc_id")) == 0).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(read(spark, sf_dir, "documents"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_recurring_lines(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_dropped_").alias("n_dropped"), F.sha2("kept_text_", 256).alias("kept_sha256"))


ORACLE["op3_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
words AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda t: t <> '') AS words FROM lines),
parsed AS (
  SELECT doc_id, line_no, CASE WHEN 2 * len(list_filter(words, lambda t: regexp_matches(t, '[0-9]'))) <= len(words)
    THEN list_transform(words, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) ELSE words END AS tokens FROM words WHERE len(words) > 0),
exact AS (SELECT tokens, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM parsed GROUP BY tokens),
numbered AS (SELECT row_number() OVER () AS id, tokens, len(tokens) AS n, list_slice(tokens, 1, 4) AS lead, first_doc, last_doc FROM exact),
leaves AS (SELECT n, lead FROM numbered WHERE n - 1 >= 0.8 * n GROUP BY n, lead HAVING count(*) > 1 AND min(first_doc) < max(last_doc)),
places AS (
  SELECT t.id, t.n, t.lead, t.first_doc, t.last_doc, t.tokens, unnest(range(1, t.n + 1)) AS place, unnest(t.tokens) AS token FROM numbered t JOIN leaves USING (n, lead)),
rests AS (SELECT id, first_doc, place, list_concat(list_slice(tokens, 1, place - 1), ['<*>'], list_slice(tokens, place + 1, n)) AS rest FROM places),
one_place AS (
  SELECT r.id, g.cut FROM rests r JOIN (SELECT place, rest, min(first_doc) AS cut FROM rests GROUP BY place, rest HAVING count(*) > 1) g ON r.place = g.place AND r.rest = g.rest),
fixed AS (SELECT n, lead, place, token FROM places GROUP BY ALL HAVING count(*) > 1 AND min(first_doc) < max(last_doc)),
marked AS (
  SELECT p.id, p.n, p.lead, p.first_doc, count(f.place) AS n_fixed, list(CASE WHEN f.place IS NOT NULL THEN p.token END ORDER BY p.place) AS template
  FROM places p LEFT JOIN fixed f ON p.n = f.n AND p.lead = f.lead AND p.place = f.place AND p.token = f.token
  GROUP BY p.id, p.n, p.lead, p.first_doc),
general AS (SELECT id, template, first_doc FROM marked WHERE n_fixed < n AND n_fixed >= 0.8 * n),
rare AS (SELECT id, min(first_doc) OVER (PARTITION BY template) AS cut FROM general),
cuts AS (SELECT id, min(cut) AS cut FROM (SELECT * FROM one_place UNION ALL SELECT * FROM rare) GROUP BY id),
known AS (SELECT tokens, least(first_doc, coalesce(cut, first_doc)) AS early FROM numbered LEFT JOIN cuts USING (id)),
drops AS (SELECT p.doc_id, p.line_no FROM parsed p JOIN known k USING (tokens) WHERE p.doc_id > k.early),
rest AS (
  SELECT l.doc_id, count(*) AS n_lines, count(d.line_no) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE d.line_no IS NULL), '') AS kept_text
  FROM lines l LEFT JOIN drops d ON l.doc_id = d.doc_id AND l.line_no = d.line_no GROUP BY l.doc_id)
SELECT t.doc_id, CAST(coalesce(r.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_dropped, 0) AS BIGINT) AS n_dropped, sha256(r.kept_text) AS kept_sha256
FROM documents t LEFT JOIN rest r ON t.doc_id = r.doc_id
"""


@query
def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


@query
def op6_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "curve_key")


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find(read(spark, sf_dir, "documents"), pii.load())
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, pii.KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
