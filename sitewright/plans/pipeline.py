"""The search for neutral integration sites."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewright.functions.networks import with_network_score
from sitewright.functions.scoring import rule_score, scaled, window_features, with_model_score
from sitewright.functions.sequences import compared_location, contains_any, context_window, context_window_5prime, gc_percent, has_run, plain_letters, reported_location, reverse_complement, self_complementarity
from sitewright.operators.genes import annotate_sites, sites_in_zones
from sitewright.operators.offtarget import specific_guides
from sitewright.operators.sites import guide_library, site_tiles, sites_of, unique_guides
from sitewright.params import SiteParams, motif_list
from sitewright.plans.stage import cut


@dataclass(frozen=True)
class Scorer:
    """A score for the sites of one PAM and orientation.

    ``size`` letters up to the PAM (3') or after it (5') and those around it make the context window; ``add`` takes a
    table, the window's column and the name of the score, and returns the table with the score.
    """

    add: Callable[[DataFrame, str, str], DataFrame]
    pam: str = "NGG"
    orientation: str = "3prime"
    size: int = 24

    def window(self, guide_length: int) -> Column:
        left, right = plain_letters(F.col("left_arm")), plain_letters(F.col("right_arm"))
        guide, pam = plain_letters(F.col("guide")), plain_letters(F.col("pam"))
        return (context_window if self.orientation == "3prime" else context_window_5prime)(left, guide, pam, right, guide_length, self.size)


def network_scorer(weights: dict, orientation: str = "3prime") -> Scorer:
    """The small convolutional networks, of 28 letters around NGG or of 32 around TTTV, with the user's weights."""
    pam, size, whole = ("NGG", 22, 28) if orientation == "3prime" else ("TTTV", 27, 32)
    return Scorer(lambda df, window, name: with_network_score(df, window, whole, weights, name), pam, orientation, size)


def model_scorer(path: str, features: Callable[[Column], Column] = window_features, scale: bool = False) -> Scorer:
    """An ONNX regression on features of the 30-letter window; ``scale`` brings its values to 0..1 over all sites."""

    def add(df: DataFrame, window: str, name: str) -> DataFrame:
        scored = with_model_score(df.withColumn("features", features(F.col(window))), "features", path, name).drop("features")
        return scaled(cut(scored), name, name) if scale else scored

    return Scorer(add)


#: Scorers by name. Those with own weights are made by ``network_scorer`` and ``model_scorer``.
SCORERS = {"rule_set": Scorer(lambda df, window, name: df.withColumn(name, rule_score(F.col(window))))}


def guide_passes(guide: Column, params: SiteParams) -> Column:
    """The filters that look at a guide's letters only; those left at their neutral values add nothing."""
    ok = F.lit(True)
    motifs = motif_list(params.re_guide)
    if motifs:
        ok = ok & ~contains_any(guide, motifs) & ~contains_any(reverse_complement(guide), motifs)
    if params.gc_range != (0, 100):
        ok = ok & gc_percent(guide).between(*params.gc_range)
    for size, pair in ((params.poly_g_guide, "GC"), (params.poly_t_guide, "TA")):
        if size:
            ok = ok & ~has_run(guide, pair[0], size) & ~has_run(guide, pair[1], size)
    return ok


def arms_pass(left: Column, right: Column, params: SiteParams) -> Column:
    """The filters of the arms: motifs forward only, runs of one letter on the left and of its partner on the right."""
    left, right = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    ok = F.lit(True)
    motifs = motif_list(params.re_arm)
    if motifs:
        ok = ok & ~contains_any(left, motifs) & ~contains_any(right, motifs)
    for size, pair in ((params.poly_g_arm, "GC"), (params.poly_t_arm, "TA")):
        if size:
            ok = ok & ~has_run(left, pair[0], size) & ~has_run(right, pair[1], size)
    return ok


def chromosome_names(features: DataFrame) -> DataFrame:
    """(accession, name, first_row): the name in the first row of each accession, by row number."""
    first = F.min(F.struct("feature_row", "name"))
    return features.where(F.col("accession").isNotNull()).groupBy("accession").agg(first.alias("f")).select("accession", F.col("f.name").alias("name"), F.col("f.feature_row").alias("first_row"))


def candidate_sites(genome: DataFrame, params: SiteParams, sites: DataFrame | None = None, arms: bool = True) -> tuple[DataFrame, DataFrame]:
    """The sites with unique guides that pass the letter filters, and the guide library they were compared with."""
    if sites is None:
        tiles = cut(site_tiles(genome, params))  # sequences are dealt out once and scanned twice
        sites, guides = sites_of(tiles, params, arms), sites_of(tiles, params, False)
    else:
        guides = sites
    library = cut(guide_library(guides))  # read twice, by the uniqueness rules and by the comparison
    kept = sites.where(guide_passes(F.col("guide"), params)).join(unique_guides(library, params), "guide", "left_semi")
    return kept.withColumn("x", compared_location(F.col("location"), F.col("strand"), F.col("chrom_length"))), library


def neutral_sites(genome: DataFrame, features: DataFrame, genes: DataFrame, params: SiteParams, scorer: str | Scorer = "rule_set", sites: DataFrame | None = None, zones: DataFrame | None = None) -> DataFrame:
    """All candidate sites with their annotation, in the columns of the result table.

    ``genome`` has accession, seq and chrom_length; ``features`` accession, name and feature_row; ``genes`` accession,
    start, stop, strand and tag. The filters that need one site only come before the comparison with the library, which
    is never thinned out by them. An empty genome gives an empty result. A ``scorer`` that is made for another PAM or
    orientation leaves the score null. With ``zones`` (``numbered_zones``) the result has the zone of each site, null
    where it lies in none.
    """
    params.check()
    kept, library = candidate_sites(genome, params, sites)
    kept = kept.where(~((F.col("location") < params.distal_end) | (F.col("location") > F.col("chrom_length") - params.distal_end)))
    kept = kept.where(arms_pass(F.col("left_arm"), F.col("right_arm"), params)).join(chromosome_names(features), "accession")
    kept = cut(annotate_sites(kept, genes, genome, params.intergenic_space, params.density_length))
    good = specific_guides(kept.select("guide"), library, params.guide_length, params.edit_distance, params.distance)
    found = kept.join(good, "guide")
    glen, plen = params.guide_length, len(params.pam)
    scorer = SCORERS[scorer] if isinstance(scorer, str) else scorer
    if (params.pam, params.orientation) == (scorer.pam, scorer.orientation):
        found = scorer.add(found.withColumn("window", scorer.window(glen)), "window", "score")
    else:
        found = found.withColumn("score", F.lit(None).cast("double"))
    found = sites_in_zones(found, zones) if zones is not None else found
    return found.select(
        F.col("guide").alias("guide_sequence"), "pam", "accession", gc_percent(F.col("guide")).alias("gc_content"), self_complementarity(F.col("guide"), glen, params.gc_scale).alias("self_complementarity"),
        reported_location(F.col("location"), F.col("strand"), F.col("chrom_length"), glen, plen).alias("site_location"), F.col("name").alias("chromosome"), "strand", "chrom_length",
        F.col("nearest").alias("closest_off_target"), F.col("nearest_distance").alias("off_target_distance"), "intergenic_size", "left_gene", "right_gene", "relative_orientation", "gene_density",
        F.col("left_arm").alias("left_hr"), F.col("right_arm").alias("right_hr"), F.col("score").alias("on_target_score"), "x", *(["zone"] if zones is not None else []),
    )


def numbered(result: DataFrame) -> DataFrame:
    """The result with an id from 1 by accession, location, strand and guide. Ids are global, so all rows are sorted;
    they are counted by range partition and added up, not in one task."""
    order = ["accession", "site_location", "strand", "guide_sequence"]
    ranged = result.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    ranged = cut(ranged)
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first_id"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("part", "first_id", F.coalesce(before, F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(counts), "part").withColumn("id", F.col("before") + F.col("row") - F.col("first_id") + 1).drop("part", "row", "first_id", "before")
