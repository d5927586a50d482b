"""From raw documents to packed token sequences: toxicity, line dedup, near-dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir), works on everything that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilespark.llm import line_dedup, mixing, packing, simhash_dedup, toxicity
from tilespark.llm.common import id_remainder, read, unused
from tilespark.sources.store import remove, shared_folder

LEAST = -(1 << 63)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. Learns from labelled documents whose id has a remainder other than 0. Null and empty
    texts are scored as no words; repeated rows go or stay together; other columns stay whatever their names."""
    learn = id_remainder(F.col("doc_id")) != 0
    model = toxicity.fit(docs.filter(learn), read(spark, sf_dir, "labels").filter(learn))
    (score,) = unused(docs, "toxicity_score_")
    return toxicity.with_score(docs, model, score).filter(F.col(score) < 0.5).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, documents stay: one that loses all its lines has an empty text. n_chars follows the text."""
    kept, lines, dropped = unused(docs, "kept_", "n_lines_", "n_dropped_")
    rows = line_dedup.drop_recurring_lines(docs, kept_col=kept, lines_col=lines, dropped_col=dropped)
    changed = {"text": F.col(kept)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(dropped) > 0, F.char_length(kept).cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumns(changed).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; null ids stay where nothing else does. Null,
    empty and blank texts are alike, so one of them stays. Rows with the id that stays all stay."""
    groups = simhash_dedup.near_duplicates(docs)
    (kept,) = unused(docs, "kept_")
    stay = groups.filter(F.coalesce("doc_id", F.lit((1 << 63) - 1)) == F.col("component_id")).select(F.coalesce("doc_id", F.lit(LEAST)).alias(kept)).distinct()
    return docs.join(stay, F.coalesce("doc_id", F.lit(LEAST)) == F.col(kept), "left_semi").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, one or two times. Null texts have no words, and a null source is a
    source of its own. Rows with equal ids share their copies, by text. Other columns stay whatever their names."""
    id_, key, copies, rows, place, copy = unused(docs, "mix_id_", "mix_key_", "copies_", "rows_", "place_", "copy_")
    own = F.coalesce("doc_id", F.lit(LEAST))
    taken = mixing.mix_sources(docs).groupBy(own.alias(key)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    turn = F.row_number().over(Window.partitionBy(id_).orderBy("text"))
    found = docs.withColumn(id_, own).withColumn(place, turn).join(taken, F.col(id_) == F.col(key))
    times = F.floor(F.col(copies) / F.col(rows)) + (F.col(place) <= F.col(copies) % F.col(rows)).cast("long")
    return found.withColumn(copy, F.explode(F.array_repeat(F.lit(True), times.cast("int")))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences, with their ids. Null and empty texts are the end id alone; repeated rows, as copies of
    the mix are, are packed each."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "token_bytes")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_dedup", drop_near_duplicates), ("mixing", mix), ("packing", pack)]

#: Training a classifier and drawing copies have no SQL; tests/llm/test_pipeline.py has a plain version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder, and removed there once the next
    stage is written. The last of these tables stays, since the result reads it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    rows, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, rows, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
        rows = spark.read.parquet(before)
    return STAGES[-1][1](spark, rows, sf_dir)
