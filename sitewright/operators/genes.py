"""Genes around a site: free space, neighbours, density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewright.functions.sequences import relative_orientation

BIN = 1_000


def _bin(position: Column, size: int) -> Column:
    return F.floor(position / size).cast("bigint")


def _summed(steps: DataFrame, columns: list[str], size: int) -> DataFrame:
    """``steps`` (accession, at, ``columns``), one row a place, with the sums up to each place, and ``bin``.

    Sums run within stretches of ``size`` bases, of at most ``size`` places, and start from those of the stretches before.
    """
    binned = steps.withColumn("bin", _bin(F.col("at"), size))
    totals = binned.groupBy("accession", "bin").agg(*(F.sum(c).alias(c) for c in columns))
    earlier = Window.partitionBy("accession").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("accession", "bin", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in columns))
    inside = Window.partitionBy("accession", "bin").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    met = binned.join(totals, ["accession", "bin"])
    return met.withColumns({c: F.sum(c).over(inside) + F.col(f"{c}_before") for c in columns}).drop(*(f"{c}_before" for c in columns))


def _ranked(genes: DataFrame, size: int) -> DataFrame:
    """Genes with ``rank``: their place from 0 by start, stop and tag in the accession.

    Genes are counted by start and the counts added up, so only genes of one start have to be sorted in one task.
    """
    counts = genes.groupBy("accession", F.col("start").alias("at")).agg(F.count("*").alias("n"))
    up_to = _summed(counts, ["n"], size).select("accession", F.col("at").alias("start"), "n")
    same = Window.partitionBy("accession", "start")
    inside = F.row_number().over(same.orderBy("stop", "tag", "strand"))
    return genes.join(up_to, ["accession", "start"]).withColumn("rank", F.col("n") - F.count("*").over(same) + inside - 1).drop("n")


def _left_rank(x: Column) -> Column:
    """Rank of the gene that counts as the left neighbour, from the number of stops before ``x``; null for none."""
    return F.when(x >= F.col("first_start"), F.when(x > F.col("last_stop"), F.col("n_genes") - 1).when(F.col("passed") > 0, F.col("passed") - 1))


def _right_rank(x: Column) -> Column:
    return F.when(x < F.col("first_start"), F.lit(0).cast("bigint")).when((x <= F.col("last_stop")) & (F.col("passed") > 0), F.col("passed"))


def gene_steps(genes: DataFrame, contigs: DataFrame, space: int, window: int, size: int = BIN) -> DataFrame:
    """One row (accession, bin, places, steps) for every stretch of ``size`` bases of the contigs (accession, chrom_length).

    What the genes mean to a site changes at a few places only: ``places`` are those in the stretch, the stretch's first
    one among them, in order, and ``steps`` what holds from each on: ``covering`` (the genes that the place is in or nearer
    to than ``space``), gene_density, left_gene, right_gene, intergenic_size and relative_orientation. Genes that change
    something at one place are added up before, so a row has at most ``size`` steps, however many genes a contig has.
    """
    sized = contigs.groupBy("accession").agg(F.max("chrom_length").alias("chrom_length"))
    known = genes.join(sized, "accession")
    start, stop, none, one = F.col("start"), F.col("stop"), F.lit(0), F.lit(1)
    covers = F.when(stop - start + 2 * space >= 2, 1).otherwise(0)
    counted = F.when((start > 0) & (stop < F.col("chrom_length")) & (start - stop + 2 * window >= 2), 1).otherwise(0)

    def step(at: Column, covering: Column = none, whole: Column = none, passed: Column = none) -> Column:
        return F.struct(at.cast("bigint").alias("at"), covering.alias("covering"), whole.alias("whole"), passed.alias("passed"))

    changes = F.array(step(start - space + 1, covers), step(stop + space, -covers), step(stop - window + 1, whole=counted), step(start + window, whole=-counted), step(stop + 1, passed=one))
    ends = known.groupBy("accession").agg(F.count("*").alias("n_genes"), F.min("start").alias("first_start"), F.max(F.struct("start", "stop")).getField("stop").alias("last_stop"))
    steps = known.select("accession", "chrom_length", F.inline(changes)).where(F.col("at") <= F.col("chrom_length")).drop("chrom_length")
    firsts = sized.select("accession", F.explode(F.sequence(F.lit(0).cast("bigint"), _bin(F.col("chrom_length"), size))).alias("at"))
    plain = firsts.withColumn("at", F.col("at") * size).union(ends.select("accession", "first_start"))
    steps = steps.union(plain.select("accession", "at", none, none, none)).groupBy("accession", F.greatest("at", F.lit(0).cast("bigint")).alias("at"))
    sums = ["covering", "whole", "passed"]
    state = _summed(steps.agg(*(F.sum(c).alias(c) for c in sums)), sums, size).join(ends, "accession", "left")
    state = state.select("accession", "bin", "at", "covering", F.when(F.col("n_genes").isNotNull(), F.col("whole").cast("int")).alias("gene_density"), _left_rank(F.col("at")).alias("left_rank"), _right_rank(F.col("at")).alias("right_rank"))
    ranked = _ranked(genes, size)
    left = ranked.select("accession", F.col("rank").alias("left_rank"), F.col("tag").alias("left_gene"), F.col("strand").alias("left_strand"), F.col("stop").alias("left_stop"))
    right = ranked.select("accession", F.col("rank").alias("right_rank"), F.col("tag").alias("right_gene"), F.col("strand").alias("right_strand"), F.col("start").alias("right_start"))
    state = state.join(left, ["accession", "left_rank"], "left").join(right, ["accession", "right_rank"], "left")
    between = (F.col("right_start") - F.col("left_stop")).alias("intergenic_size")
    found = F.struct("at", "covering", "gene_density", "left_gene", "right_gene", between, relative_orientation(F.col("left_strand"), F.col("right_strand")).alias("relative_orientation"))
    rows = state.groupBy("accession", "bin").agg(F.array_sort(F.collect_list(found)).alias("steps"))
    return rows.select("accession", "bin", F.col("steps.at").alias("places"), "steps")


def annotate_sites(sites: DataFrame, genes: DataFrame, contigs: DataFrame, space: int, window: int, only_free: bool = True, size: int = BIN) -> DataFrame:
    """``sites`` with intergenic_size, left_gene, right_gene, relative_orientation and gene_density.

    ``sites`` need columns accession, x (the coordinate compared with genes) and chrom_length; ``genes`` accession,
    start, stop, strand and tag, without nulls in the first three; ``contigs`` accession and chrom_length. With
    ``only_free``, sites inside a gene or nearer than ``space`` to one are left out. The left neighbour is the gene
    whose rank by start is one below the number of genes that stop before the site, the right one has the next rank;
    nested genes can make the size negative. The density counts the genes that lie whole between ``window`` bases before
    and after the site. Values are null where there is no neighbour or the contig has no genes.

    Sites meet genes once, by (accession, stretch), never by accession alone, so a contig with most of the sites spreads
    over the cluster; see ``gene_steps`` for contigs with most of the genes.
    """
    met = sites.withColumn("bin", _bin(F.col("x"), size)).join(gene_steps(genes, contigs, space, window, size), ["accession", "bin"], "left")
    passed = F.size(F.filter("places", lambda at: at <= F.col("x")))
    met = met.withColumn("step", F.get("steps", passed - 1))
    if only_free:
        met = met.where(F.coalesce(F.col("step.covering"), F.lit(0)) <= 0)
    return met.select(*sites.columns, *(f"step.{c}" for c in ("left_gene", "right_gene", "intergenic_size", "relative_orientation", "gene_density")))


def gaps_between(genes: DataFrame, contigs: DataFrame, size: int = BIN) -> DataFrame:
    """Zones (accession, zone_index, low, high) before, between and after the genes of each contig in order of start.

    A contig without genes is one zone. Nested genes can make a zone empty (low above high); contigs without length give
    their last zone a null end. Zones of one accession come in order of ``zone_index``.
    """
    sized = contigs.select("accession", "chrom_length")
    ranked = _ranked(genes, size)
    following = ranked.select("accession", (F.col("rank") - 1).alias("rank"), F.col("start").alias("next"))
    after = ranked.join(following, ["accession", "rank"], "left").join(sized, "accession", "left")
    after = after.select("accession", (F.col("rank") + 1).cast("int").alias("zone_index"), F.col("stop").alias("low"), F.coalesce("next", "chrom_length").alias("high"))
    first = ranked.where(F.col("rank") == 0).select("accession", F.lit(0).alias("zone_index"), F.lit(0).cast("bigint").alias("low"), F.col("start").alias("high"))
    empty = sized.join(genes.select("accession").distinct(), "accession", "left_anti").select("accession", F.lit(0).alias("zone_index"), F.lit(0).cast("bigint").alias("low"), F.col("chrom_length").alias("high"))
    return first.unionByName(after).unionByName(empty)


def numbered_zones(zones: DataFrame, order: DataFrame) -> DataFrame:
    """``zones`` with ``zone``, running from 1 over all accessions in the order of ``order`` (accession, first_row).

    The zones of the accessions before are added up from one count an accession, so only those counts are sorted in one
    place; within an accession the zone index counts.
    """
    counts = zones.groupBy("accession").agg(F.count("*").alias("n")).join(order, "accession", "left")
    running = F.sum("n").over(Window.orderBy(F.col("first_row").asc_nulls_last(), "accession").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("accession", F.coalesce(running, F.lit(0)).alias("offset"))
    return zones.join(offsets, "accession").select("accession", "low", "high", (F.col("offset") + F.col("zone_index") + 1).alias("zone"))


def sites_in_zones(sites: DataFrame, zones: DataFrame, size: int = BIN) -> DataFrame:
    """``sites`` with the ``zone`` that holds x strictly between its ends, null for none (at an end or inside a gene).

    Sites and zones meet by (accession, stretch): a zone is offered to every stretch it touches.
    """
    offered = zones.where(F.col("low") < F.col("high")).select("accession", "low", "high", "zone", F.explode(F.sequence(_bin(F.col("low"), size), _bin(F.col("high"), size))).alias("bin"))
    offers = offered.groupBy("accession", "bin").agg(F.collect_list(F.struct("low", "high", "zone")).alias("offers"))
    met = sites.withColumn("bin", _bin(F.col("x"), size)).join(offers, ["accession", "bin"], "left")
    holding = F.filter("offers", lambda z: (z["low"] < F.col("x")) & (F.col("x") < z["high"]))
    return met.withColumn("zone", F.get(holding, F.lit(0))["zone"]).drop("bin", "offers")
