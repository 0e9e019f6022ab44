"""Tables for plots and small statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _labelled(result: DataFrame) -> DataFrame:
    kinds = result.agg(F.countDistinct("chromosome").alias("names"), F.countDistinct("accession").alias("accessions"), F.count_if(F.col("chromosome").isNull() | (F.col("chromosome") == "nan")).alias("missing"))
    named = (F.col("names") == F.col("accessions")) & (F.col("missing") == 0)
    labelled = result.crossJoin(F.broadcast(kinds)).withColumn("label", F.when(named, F.col("chromosome")).otherwise(F.col("accession")))  # one row
    return labelled.where(F.col("label").isNotNull()).drop("names", "accessions", "missing")


def plot_labels(result: DataFrame) -> DataFrame:
    """(label, length): chromosomes if each has one accession and all are named, accessions otherwise.

    The length is the largest that the label's rows give, null if none does. Ties and repeated rows make no difference;
    an empty result has no labels.
    """
    return _labelled(result).groupBy("label").agg(F.max("chromosome_length").alias("length"))


def plot_segments(result: DataFrame) -> DataFrame:
    """One upright stroke a site: x, y from 0.25 below to 0.25 above the line of the label that ``plot_labels`` chooses,
    the site's id and guide, and the flanking genes. Lines are counted from the first label by name."""
    labelled = _labelled(result)
    lines = labelled.select("label").distinct().withColumn("line", F.row_number().over(Window.orderBy("label")) - 0.5)  # one row a chromosome
    genes = F.concat_ws(",", F.coalesce("left_gene", F.lit("-")), F.coalesce("right_gene", F.lit("-")))
    met = labelled.join(lines, "label")
    return met.select("site_id", "label", "guide", F.col("site_location").alias("x"), (F.col("line") - 0.25).alias("y0"), (F.col("line") + 0.25).alias("y1"), genes.alias("genes"))


def long_form(df: DataFrame, key: str, means: Sequence[str], deviations: Sequence[str]) -> DataFrame:
    """(key, name, mean, deviation) from paired blocks of wide columns; the names are those of ``means``."""
    pairs = F.array(*(F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("mean"), F.col(d).cast("double").alias("deviation")) for m, d in zip(means, deviations, strict=True)))
    return df.select(key, F.inline(pairs))


def row_statistics(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, mean, deviation) over the non-null values of several columns of a row; population deviation."""
    values = F.filter(F.array(*(F.col(c).cast("double") for c in columns)), lambda v: v.isNotNull())
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.nullif(n, F.lit(0))
    with_mean = df.select(key, values.alias("v"), mean.alias("mean"))
    square = F.aggregate("v", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean")))
    return with_mean.select(key, "mean", F.sqrt(square / F.nullif(F.size("v"), F.lit(0))).alias("deviation"))


def fitted_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope and intercept of y over x, for each group; rows with a null take no part."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns brought to mean 0 and sample deviation 1; constant columns and those without values become null."""
    ends = df.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("dev", F.stddev_samp)))).first()
    scaled = {c: (F.col(c) - ends[f"{c}_mean"]) / ends[f"{c}_dev"] if ends[f"{c}_dev"] else F.lit(None).cast("double") for c in columns}
    return df.withColumns(scaled)


def first_rows(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key by an explicit order; ties are settled by all other columns."""
    rest = [F.col(c) for c in df.columns if c not in order and c != key]
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order, *rest))).where(F.col("_place") == 1).drop("_place")


def over_runs(counts: DataFrame, run: str, by: Sequence[str], value: str) -> DataFrame:
    """Mean and population deviation of ``value`` over the runs, for each combination of ``by``; a run without a row for
    a combination counts as 0."""
    runs = counts.select(run).distinct().count()
    sums = counts.groupBy(run, *by).agg(F.sum(value).cast("double").alias("v")).groupBy(*by).agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    mean = F.col("s") / runs if runs else F.lit(None).cast("double")
    square = F.greatest(F.col("q") / runs - mean * mean, F.lit(0.0)) if runs else F.lit(None).cast("double")
    return sums.select(*by, mean.alias("mean"), F.sqrt(square).alias("deviation"))
