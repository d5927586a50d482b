"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_folder

#: The word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows and bytes of one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch can hold, so that very long texts do not meet in one Python worker.

    Spark reads these settings when a plan runs, which is after the operator has returned, so they stay in the session; all
    operators set the same ones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Rows of a narrow table that are worth a file of their own.
FILE_ROWS = 50_000


def shared_checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage through the shared folder. Each partition becomes a file, which is a few requests to the store, or a
    few processes where Hadoop sets rights by ``chmod``. Where about ``rows`` rows are to come, partitions that are much
    smaller than ``FILE_ROWS`` share files."""
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(doc_id: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo; a null id counts as remainder 0 (held out, never learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(0))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale and the other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores more as it takes to differ from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row, also where lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_words(text: Column) -> Column:
    """Array of words of a text that is not null, without empty ones."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
