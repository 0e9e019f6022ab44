"""Sites of contigs as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sitewright.functions.sequences import letters
from sitewright.operators.sites import find_sites
from sitewright.params import SiteParams
from sitewright.plans.pipeline import arms_pass, guide_passes
from sitewright.sources.files import without_organelles

CONTIGS = "record_id bigint, accession string, description string, seq string, seq_length bigint, loaded_at timestamp"


def arriving_contigs(spark: SparkSession, path: str, schema: str = CONTIGS) -> DataFrame:
    """A stream of the parquet files that are added to a folder."""
    return spark.readStream.schema(schema).parquet(path)


def arriving_sites(contigs: DataFrame, params: SiteParams) -> DataFrame:
    """The sites of each arriving record that pass the filters which look at one site only.

    Filters that need the whole library (unique guides and seeds, similar guides) have no place in a stream; see
    ``write_new_guides``.
    """
    clean = without_organelles(contigs).select("accession", letters(F.col("seq")).alias("seq"))
    sites = find_sites(clean, params)
    d = params.distal_end
    kept = sites.where(guide_passes(F.col("guide"), params) & arms_pass(F.col("left_arm"), F.col("right_arm"), params))
    return kept.where(~((F.col("location") < d) | (F.col("location") > F.col("chrom_length") - d)))


def recent_site_counts(sites_with_time: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Sites per accession and window of ``loaded_at``, final once the watermark has passed."""
    timed = sites_with_time.withWatermark("loaded_at", late)
    return timed.groupBy(F.window("loaded_at", window), "accession").agg(F.count("*").alias("sites")).select(F.col("window.start").alias("begin"), "accession", "sites")


def write_new_guides(sites: DataFrame, library_path: str, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that hands ``sink`` the sites of each batch whose guide the stored library (column guide) lacks."""

    def batch(found: DataFrame, number: int) -> None:
        sink(found.join(found.sparkSession.read.parquet(library_path).select("guide"), "guide", "left_anti"), number)

    return sites.writeStream.foreachBatch(batch)
