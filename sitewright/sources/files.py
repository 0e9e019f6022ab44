"""Files of sequences, features and hits."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions.sequences import letters

ORGANELLES = ("mitochondrion", "plastid", "chloroplast")

FEATURE_SCHEMA = (
    "`# feature` string, class string, assembly string, assembly_unit string, seq_type string, chromosome string, genomic_accession string, start bigint, `end` bigint, strand string, "
    "product_accession string, `non-redundant_refseq` string, related_accession string, name string, symbol string, GeneID string, locus_tag string, feature_interval_length bigint, product_length bigint, attributes string"
)
HIT_SCHEMA = "query string, subject string, pc_identity double, aln_length int, mismatches int, gaps_opened int, query_start int, query_end int, subject_start int, subject_end int, e_value double, bitscore double"


def without_organelles(records: DataFrame, description: str = "description") -> DataFrame:
    """Records whose description names no organelle; a null description stays."""
    return records.where(~F.coalesce(F.col(description).rlike("|".join(ORGANELLES)), F.lit(False)))


def read_fasta(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Records (accession, description, seq) of FASTA files, organelles left out, letters in capitals."""
    lines = spark.read.option("lineSep", ">").text(path if isinstance(path, str) else list(path))
    head = F.substring_index(F.col("value"), "\n", 1)
    body = F.substr(F.col("value"), F.length(head) + 2)
    records = lines.where(F.length(F.trim("value")) > 0).select(F.regexp_extract(head, r"^(\S+)", 1).alias("accession"), F.trim(F.regexp_replace(head, r"[\r\n]", "")).alias("description"), letters(body).alias("seq"))
    return without_organelles(records)


def read_features(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A feature table as published: tab-separated, the column names in the first line."""
    return spark.read.csv(path, sep="\t", header=True, schema=FEATURE_SCHEMA)


def read_hits(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Hits of a similarity search: twelve tab-separated columns without names."""
    return spark.read.csv(path, sep="\t", schema=HIT_SCHEMA)


def read_essential(spark: SparkSession, path: str | Sequence[str], organisms: Sequence[str]) -> DataFrame:
    """(DEG_id, Sequence) of an essential-gene table, the rows of the given organisms."""
    rows = spark.read.csv(path, header=True)
    return rows.where(F.col("Organism").isin(*organisms)).select(F.col(rows.columns[0]).alias("DEG_id"), F.col(rows.columns[1]).alias("Sequence"))


def search_hits(queries: DataFrame, key: str, seq: str, command: Sequence[str]) -> DataFrame:
    """Hits of an outside search program that every executor has: it reads FASTA and writes twelve tab-separated columns.

    Each partition runs the program once over its own records. Rows with a null key or sequence are left out.
    """
    command = list(command)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = [line.as_py() for batch in batches for line in batch.column(0)]
        if lines:
            found = subprocess.run(command, input="".join(lines), capture_output=True, text=True, check=True).stdout
            rows = [line.split("\t") for line in found.splitlines()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(12)], names)

    fields = [field.split(" ") for field in HIT_SCHEMA.split(", ")]
    names = [name for name, _ in fields]
    records = queries.select(F.concat(F.lit(">"), F.col(key), F.lit("\n"), F.col(seq), F.lit("\n")).alias("record")).where(F.col("record").isNotNull())
    hits = records.mapInArrow(run, ", ".join(f"{name} string" for name in names))
    return hits.select(*(F.col(name).cast(kind).alias(name) for name, kind in fields))


def read_model_options(path: str) -> dict:
    """The switches of a feature model from a small JSON file."""
    return json.loads(Path(path).read_text())


def read_runs(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Tab-separated files of several runs, each row with its file's name in ``run``."""
    return spark.read.csv(list(paths), sep="\t", header=True, schema=schema).withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -1))


def write_fasta(df: DataFrame, path: str, key: str, seq: str) -> None:
    """One record a row; rows with a null key or sequence are left out."""
    df.select(F.concat(F.lit(">"), F.col(key), F.lit("\n"), F.col(seq)).alias("value")).where(F.col("value").isNotNull()).write.text(path)


def write_result(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """CSV files with column names, '-' for nulls; with ``order`` sorted over all files, whose names follow it."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows.write.csv(path, header=True, nullValue="-", emptyValue="")


def read_result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result CSV with typed columns; missing text reads as 'nan'."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="-").fillna("nan")
