"""Reads and strings that keep coming: the same stateless transforms, in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.codes import kmer_codes
from ..functions.seqexpr import kmers
from ..sources.schemas import FASTX


def stream_fasta(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """(name, seq) of the FASTA files that appear in a folder, ``files`` of them a batch at most."""
    reader = spark.readStream.option("lineSep", "\n>")
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    text = reader.text(folder)
    record = F.regexp_replace(F.regexp_replace("value", "^\\s*>", ""), "\\r", "")
    body = F.substr(record, F.instr(record, "\n") + 1)
    return text.where("trim(value) <> ''").select(F.regexp_extract(record, "^(\\S*)", 1).alias("name"), F.regexp_replace(body, "\\s", "").alias("seq"))


def stream_table(spark: SparkSession, folder: str, schema: str = FASTX) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def stream_missed(reads: DataFrame, sketch: DataFrame, k: int) -> DataFrame:
    """Each k-mer of each read with whether the (static) sketch holds it, as text or as codes; stateless, so a query may append it."""
    as_text = isinstance(sketch.schema["kmer"].dataType, StringType)
    own = (kmers if as_text else kmer_codes)(reads, "seq", k, ["name"])
    return own.join(sketch.select("kmer", F.lit(True).alias("hit")), "kmer", "left").select("name", "pos", F.coalesce("hit", F.lit(False)).alias("hit"))


def first_deliveries(strings: DataFrame, key: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Rows of a stream without those delivered again within ``late``; state older than that is given up."""
    return strings.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def arrivals(strings: DataFrame, at: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Strings and bases in windows of event time; rows later than ``late`` don't change a window any more."""
    return strings.withWatermark(at, late).groupBy(F.window(at, window)).agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("bases"))


def write_batches(rows: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends each batch to Parquet; a batch that is run again after a failure is written once, by the sink's log."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
