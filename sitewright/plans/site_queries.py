"""Queries of the site search, from scan to result."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions.scoring import RULE_INTERCEPT, RULE_LOW_GC, RULE_PAIR, RULE_SINGLE, rule_score
from sitewright.functions.sequences import context_window, gc_percent, plain_letters, reported_location, self_complementarity
from sitewright.operators.genes import annotate_sites, gaps_between, numbered_zones, sites_in_zones
from sitewright.operators.offtarget import mismatch_counts, nearest_guides, similar_guides
from sitewright.operators.sites import find_sites, guide_library, unique_guides
from sitewright.plans.genome import FEATURES_SQL, GENOME_SQL, HITS_SQL, PARAMS, SITES_SQL, features, genes, genome, hits
from sitewright.plans.pipeline import arms_pass, candidate_sites, chromosome_names, guide_passes, neutral_sites, numbered
from sitewright.plans.stage import cut
from sitewright.sources.tables import table

G, P = PARAMS.guide_length, len(PARAMS.pam)
FILTERS = replace(PARAMS, re_guide="GAATTC,GGTCTC", gc_range=(30, 70), poly_g_guide=4, poly_t_guide=4)
ARM_FILTERS = replace(PARAMS, re_arm="GAATTC,GGTCTC", poly_g_arm=5, poly_t_arm=5)
CLASSES = 5  # off-targets are counted up to so many differing letters
_BASE = f"with {GENOME_SQL}, {SITES_SQL}"
_FULL = f"with {GENOME_SQL}, {FEATURES_SQL}, {SITES_SQL}"


def _sites(spark: SparkSession, directory: str) -> DataFrame:
    return find_sites(genome(spark, directory), PARAMS)


def genome_records(spark: SparkSession, directory: str) -> DataFrame:
    return genome(spark, directory).select("accession", "chrom_length", F.md5("seq").alias("digest"), gc_percent(F.col("seq")).alias("gc"))


def feature_table(spark: SparkSession, directory: str) -> DataFrame:
    return features(spark, directory).select("feature_row", "feature", "class", "name", "accession", "start", "stop", "strand", "tag", "product")


def site_scan(spark: SparkSession, directory: str) -> DataFrame:
    return _sites(spark, directory).select("guide", "pam", "accession", "location", "strand", "chrom_length", reported_location(F.col("location"), F.col("strand"), F.col("chrom_length"), G, P).alias("reported"))


def library_counts(spark: SparkSession, directory: str) -> DataFrame:
    return guide_library(_sites(spark, directory))


def unique_candidates(spark: SparkSession, directory: str) -> DataFrame:
    return unique_guides(guide_library(_sites(spark, directory)), PARAMS)


def filtered_guides(spark: SparkSession, directory: str) -> DataFrame:
    guides = guide_library(_sites(spark, directory)).select("guide")
    return guides.where(guide_passes(F.col("guide"), FILTERS))


def arms(spark: SparkSession, directory: str) -> DataFrame:
    return _sites(spark, directory).select("accession", "location", "strand", "pam", "left_arm", "right_arm")


def filtered_arms(spark: SparkSession, directory: str) -> DataFrame:
    return _sites(spark, directory).where(arms_pass(F.col("left_arm"), F.col("right_arm"), ARM_FILTERS)).select("accession", "location", "strand", "pam")


def _annotated(spark: SparkSession, directory: str, only_free: bool) -> DataFrame:
    contigs = cut(genome(spark, directory))  # for its sequences and for its lengths
    kept, _ = candidate_sites(contigs, PARAMS, arms=False)
    return annotate_sites(kept, genes(features(spark, directory)), contigs, PARAMS.intergenic_space, PARAMS.density_length, only_free)


def flanking_genes(spark: SparkSession, directory: str) -> DataFrame:
    return _annotated(spark, directory, False).select("accession", "location", "strand", "left_gene", "right_gene", "intergenic_size", "relative_orientation")


def intergenic_sites(spark: SparkSession, directory: str) -> DataFrame:
    return _annotated(spark, directory, True).select("accession", "location", "strand", "guide")


def gene_density(spark: SparkSession, directory: str) -> DataFrame:
    return _annotated(spark, directory, False).select("accession", "location", "strand", F.col("gene_density").cast("bigint").alias("gene_density"))


def chromosome_lookup(spark: SparkSession, directory: str) -> DataFrame:
    return chromosome_names(features(spark, directory)).select("accession", "name")


def distal_and_known(spark: SparkSession, directory: str) -> DataFrame:
    d = PARAMS.distal_end
    known = features(spark, directory).where(F.col("accession").isNotNull()).select("accession").distinct()
    kept = _sites(spark, directory).where(~((F.col("location") < d) | (F.col("location") > F.col("chrom_length") - d)))
    return kept.join(known, "accession", "left_semi").select("accession", "location", "strand", "pam")


def _compared(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    library = cut(guide_library(_sites(spark, directory)))  # read twice, by the uniqueness rules and by the comparison
    return unique_guides(library, PARAMS), library


def near_guides(spark: SparkSession, directory: str) -> DataFrame:
    return similar_guides(*_compared(spark, directory), G, PARAMS.edit_distance)


def three_nearest(spark: SparkSession, directory: str) -> DataFrame:
    return nearest_guides(*_compared(spark, directory), G, 3)


def off_target_classes(spark: SparkSession, directory: str) -> DataFrame:
    return mismatch_counts(*_compared(spark, directory), G, CLASSES)


def rule_scores(spark: SparkSession, directory: str) -> DataFrame:
    sites = _sites(spark, directory).where(F.col("left_arm").isNotNull() & F.col("right_arm").isNotNull())
    window = context_window(plain_letters(F.col("left_arm")), plain_letters(F.col("guide")), plain_letters(F.col("pam")), plain_letters(F.col("right_arm")), G)
    seen = sites.select("accession", "location", "strand", "pam", window.alias("window"))
    return seen.withColumn("score", F.round(rule_score(F.col("window")), 9))


def self_complements(spark: SparkSession, directory: str) -> DataFrame:
    return guide_library(_sites(spark, directory)).select("guide", self_complementarity(F.col("guide"), G).alias("stems"), gc_percent(F.col("guide")).alias("gc"))


def result_table(spark: SparkSession, directory: str) -> DataFrame:
    contigs, rows = cut(genome(spark, directory)), features(spark, directory)
    return numbered(neutral_sites(contigs, rows, genes(rows), PARAMS)).drop("x").withColumn("on_target_score", F.round("on_target_score", 9))


def zoned_result(spark: SparkSession, directory: str) -> DataFrame:
    """The result with its zones, without the comparison with the library."""
    contigs, rows = cut(genome(spark, directory)), features(spark, directory)
    params = replace(PARAMS, edit_distance=0)
    found = neutral_sites(contigs, rows, genes(rows), params, zones=_zones(spark, directory))
    return found.select("guide_sequence", "pam", "accession", "site_location", "strand", "zone")


def good_hits(spark: SparkSession, directory: str) -> DataFrame:
    return hits(spark, directory).where((F.col("e_value") < 1e-5) & (F.col("pc_identity") >= 50))


def essential_genes(spark: SparkSession, directory: str) -> DataFrame:
    coding = features(spark, directory).where((F.col("feature") == "CDS") & (F.col("class") == "with_protein") & F.col("accession").isNotNull() & F.col("has_start") & F.col("has_stop"))
    return coding.join(good_hits(spark, directory).select(F.col("query").alias("product")).distinct(), "product", "left_semi").select("accession", "start", "stop", "strand", "tag")


def _zones(spark: SparkSession, directory: str) -> DataFrame:
    contigs = genome(spark, directory)
    essential = essential_genes(spark, directory)
    order = features(spark, directory).groupBy("accession").agg(F.min("feature_row").alias("first_row"))
    return numbered_zones(gaps_between(essential, contigs), order)


def essential_zones(spark: SparkSession, directory: str) -> DataFrame:
    return _zones(spark, directory)


def zoned_sites(spark: SparkSession, directory: str) -> DataFrame:
    kept, _ = candidate_sites(genome(spark, directory), PARAMS, arms=False)
    return sites_in_zones(kept, _zones(spark, directory)).select("accession", "location", "strand", "zone")


_CAND = "cand as (select s.* from sites s where s.guide in (select guide from candidates))"
_RANKED = "ranked as (select *, row_number() over (partition by accession order by start, stop, tag, strand) - 1 as rank from genes)"
_ENDS = "ends as (select accession, count(*) as n_genes, min(start) as first_start, arg_max(stop, (start, stop)) as last_stop from genes group by accession)"
_PASSED = "passed as (select c.accession, c.location, c.strand, c.pam, c.x, count(g.stop) as n from cand c left join genes g on g.accession = c.accession and g.stop < c.x group by all)"
_FLANKS = f"""{_FULL}, {_CAND}, {_RANKED}, {_ENDS}, {_PASSED},
placed as (select p.*, case when x < first_start then null when x > last_stop then n_genes - 1 when n > 0 then n - 1 end as l,
                  case when x < first_start then 0 when x <= last_stop and n > 0 then n end as r from passed p left join ends e on e.accession = p.accession)
select p.accession, p.location, p.strand, a.tag as left_gene, b.tag as right_gene, b.start - a.stop as intergenic_size,
       case when a.strand is null or b.strand is null then null when a.strand = b.strand then 'tandem' when a.strand = '+' and b.strand = '-' then 'convergent' else 'divergent' end as relative_orientation
from placed p left join ranked a on a.accession = p.accession and a.rank = p.l left join ranked b on b.accession = p.accession and b.rank = p.r
"""
_FREE = f"not exists (select 1 from genes g where g.accession = c.accession and g.start - {PARAMS.intergenic_space} < c.x and c.x < g.stop + {PARAMS.intergenic_space})"
_W = PARAMS.density_length
_PLAIN = "translate({}, 'MRWSYKVHDBN', 'AAACCGAAACA')"
_WINDOW = f"right({_PLAIN.format('left_arm')}, 4) || {_PLAIN.format('guide')} || {_PLAIN.format('pam')} || left({_PLAIN.format('right_arm')}, 3)"
_RULES = " + ".join(f"case when substr(w, {int(k[-2:])}, {len(k) - 2}) = '{k[:-2]}' then {v} else 0 end" for t in (RULE_SINGLE, RULE_PAIR) for k, v in t.items())
_RC = "translate(reverse(guide), 'ACGTMRWSYKVHDBN', 'TGCAKYWSRMBDHVN')"
_ESSENTIAL = f"""with {GENOME_SQL}, {FEATURES_SQL}, {HITS_SQL}, {SITES_SQL},
good as (select * from hits where e_value < 1e-5 and pc_identity >= 50),
essential as (select accession, start, stop, strand, tag from features where feature = 'CDS' and class = 'with_protein' and accession is not null and has_start and has_stop and product in (select query from good))"""
_ZONES = f"""{_ESSENTIAL},
e as (select e.*, g.chrom_length, row_number() over w as n, lead(start) over w as next from essential e left join genome g on g.accession = e.accession window w as (partition by e.accession order by start, stop, tag, e.strand)),
z as (select accession, n as i, stop as low, coalesce(next, chrom_length) as high from e
      union all select accession, 0, 0, start from e where n = 1
      union all select accession, 0, 0, chrom_length from genome where accession not in (select accession from essential)),
o as (select accession, min(feature_row) as first_row from features group by accession),
zones as (select z.accession, cast(low as bigint) as low, cast(high as bigint) as high, row_number() over (order by first_row nulls last, z.accession, i) as zone from z left join o on o.accession = z.accession)"""


_FAR = 1 << 2 * G  # above any packed guide
_DIFFER = "bit_count((xor(a.code, b.code) | (xor(a.code, b.code) >> 1)) & 6148914691236517205)"


def _packed_sql(left: str) -> str:
    """The library (known) and the guides of ``left`` (asked), with their letters as a number, two bits each."""
    code = f"cast(list_sum([cast(strpos('CGT', substr(guide, i, 1)) as bigint) << 2 * ({G} - i) for i in range(1, {G + 1})]) as bigint) as code"
    return f"known as materialized (select guide, {code} from library), asked as materialized (select guide, {code} from {left})"


def _near_sql(within: int) -> str:
    """Pairs (a, b, distance) of asked and known guides within so many letters: such guides share one of ``within`` + 1 blocks."""
    edges = [round(i * G / (within + 1)) for i in range(within + 2)]
    block = lambda a, b: f"(({{}}.code >> {2 * (G - b)}) & {(1 << 2 * (b - a)) - 1})"
    parts = " union ".join(
        f"select a.code as a, b.code as b, cast({_DIFFER} as integer) as distance from asked a join known b on {block(x, y).format('a')} = {block(x, y).format('b')} where a.code <> b.code and {_DIFFER} <= {within}"
        for x, y in zip(edges, edges[1:], strict=False)
    )
    return f"near as materialized ({parts})"


def _nearest_sql(left: str, k: int) -> str:
    """Rows (guide, other, distance, rank), the ``k`` nearest of every asked guide: those with so many within 6 letters,
    by blocks, or else within 8 have them there, the others are compared with the whole library."""
    top = lambda name, pairs: f"{name} as materialized (select a, min(distance * {_FAR} + b, {k}) as top from {pairs} group by a having count(*) >= {k})"
    rest = lambda done, more: f"(select a.code as a, b.code as b, cast({_DIFFER} as bigint) as distance from asked a join known b on a.code <> b.code{more} where a.code not in (select a from {done}))"
    return f"""{_packed_sql(left)}, {_near_sql(6)},
{top('six', 'near')}, {top('eight', rest('six', f' and {_DIFFER} <= 8'))}, both_tiers as (select * from six union all select * from eight),
others as (select a, min(distance * {_FAR} + b, {k}) as top from {rest('both_tiers', '')} group by a),
tops as (select a, unnest(top) as t, generate_subscripts(top, 1) as rank from (select * from both_tiers union all select * from others)),
nearest as (select x.guide, y.guide as other, cast(t // {_FAR} as integer) as distance, cast(rank as integer) as rank from tops join asked x on x.code = a join known y on y.code = t % {_FAR})"""


_ASKED = f"{_BASE}, {_packed_sql('candidates')}"
_RESULT = f"""{_FLANKS.replace('select p.accession, p.location, p.strand, a.tag', ', flanks as (select p.accession, p.location, p.strand, p.pam, a.tag')}),
names as (select accession, arg_min(name, feature_row) as name from features where accession is not null group by accession),
kept as (select c.*, n.name from cand c join names n on n.accession = c.accession where location >= {PARAMS.distal_end} and location <= chrom_length - {PARAMS.distal_end} and {_FREE}),
dense as (select c.accession, c.location, c.strand, c.pam, case when max(e.n_genes) is not null then cast(count(g.start) as integer) end as gene_density from kept c left join ends e on e.accession = c.accession
          left join genes g on g.accession = c.accession and g.start > greatest(0, c.x - {_W}) and g.stop < least(c.chrom_length, c.x + {_W}) group by c.accession, c.location, c.strand, c.pam),
wanted as (select distinct guide from kept), {_nearest_sql('wanted', 1)},
good as (select k.*, n.other, n.distance from kept k left join nearest n on n.guide = k.guide where n.distance is null or n.distance >= {PARAMS.edit_distance}),
scored as (select *, {_WINDOW} as w from good),
result as (select k.guide as guide_sequence, k.pam, k.accession, 100.0 * length(regexp_replace(k.guide, '[^GCS]', '', 'g')) / length(k.guide) as gc_content,
    cast(len([j for j in range(0, {G - 4}) if regexp_matches(substr(k.guide, j + 1, 4), '[GCS]') and contains(substr({_RC.replace('guide', 'k.guide')}, 1, {G - 5} - j), substr(k.guide, j + 1, 4))]) as integer) as self_complementarity,
    case when k.strand = '+' then k.location else k.chrom_length - k.location - {G + P} end as site_location, k.name as chromosome, k.strand, k.chrom_length, k.other as closest_off_target, k.distance as off_target_distance,
    f.intergenic_size, f.left_gene, f.right_gene, f.relative_orientation, d.gene_density, k.left_arm as left_hr, k.right_arm as right_hr,
    case when length(w) = 30 then round(1 / (1 + exp(-({RULE_INTERCEPT} + {RULE_LOW_GC} + {_RULES}))), 9) end as on_target_score
  from scored k join flanks f using (accession, location, strand, pam) join dense d using (accession, location, strand, pam))
select row_number() over (order by accession, site_location, strand, guide_sequence) as id, * from result
"""


def _bad(text: str, motifs: str) -> str:
    return f"regexp_matches({text}, '{motifs}')"


QUERIES = {
    "s1_genome_records": genome_records, "s3_feature_table": feature_table, "s5_good_hits": good_hits, "g2_site_scan": site_scan, "a1_guide_library": library_counts, "flt_p2p6_unique_guides": unique_candidates,
    "flt_p3p4p5_guides": filtered_guides, "f16_homology_arms": arms, "flt_p9p10_arms": filtered_arms, "w1_flanking_genes": flanking_genes, "flt_p8_intergenic": intergenic_sites, "a3_gene_density": gene_density,
    "j7_chromosome_names": chromosome_lookup, "flt_p12p13_distal": distal_and_known, "j3_similar_guides": near_guides, "o4_three_nearest": three_nearest, "a5_mismatch_counts": off_target_classes,
    "m1_rule_scores": rule_scores, "f7_self_complementarity": self_complements, "j9_essential_genes": essential_genes, "w2w5_essential_zones": essential_zones, "j11_zoned_sites": zoned_sites, "result_neutral_sites": result_table, "result_zones": zoned_result,
}
SQL = {
    "s1_genome_records": f"with {GENOME_SQL} select accession, chrom_length, md5(seq) as digest, 100.0 * length(regexp_replace(seq, '[^GCS]', '', 'g')) / length(seq) as gc from genome",
    "s3_feature_table": f"with {FEATURES_SQL} select feature_row, feature, class, name, accession, start, stop, strand, tag, product from features",
    "s5_good_hits": f"with {HITS_SQL} select * from hits where e_value < 1e-5 and pc_identity >= 50",
    "g2_site_scan": f"{_BASE} select guide, pam, accession, location, strand, chrom_length, case when strand = '+' then location else chrom_length - location - {G + P} end as reported from sites",
    "a1_guide_library": f"{_BASE} select guide, frequency from library",
    "flt_p2p6_unique_guides": f"{_BASE} select guide from candidates",
    "flt_p3p4p5_guides": f"{_BASE} select guide from library where not {_bad('guide', 'GAATTC|GGTCTC')} and not {_bad(_RC, 'GAATTC|GGTCTC')} and 100.0 * length(regexp_replace(guide, '[^GCS]', '', 'g')) / length(guide) between 30 and 70 and not {_bad('guide', 'GGGG|CCCC|TTTT|AAAA')}",
    "f16_homology_arms": f"{_BASE} select accession, location, strand, pam, left_arm, right_arm from sites",
    "flt_p9p10_arms": f"{_BASE} select accession, location, strand, pam from sites where not {_bad('coalesce(left_arm, chr(32))', 'GAATTC|GGTCTC|GGGGG|TTTTT')} and not {_bad('coalesce(right_arm, chr(32))', 'GAATTC|GGTCTC|CCCCC|AAAAA')}",
    "w1_flanking_genes": _FLANKS,
    "flt_p8_intergenic": f"{_FULL}, {_CAND} select accession, location, strand, guide from cand c where {_FREE}",
    "a3_gene_density": f"""{_FULL}, {_CAND}, {_ENDS} select c.accession, c.location, c.strand, case when max(e.n_genes) is not null then count(g.start) end as gene_density from cand c left join ends e on e.accession = c.accession
        left join genes g on g.accession = c.accession and g.start > greatest(0, c.x - {_W}) and g.stop < least(c.chrom_length, c.x + {_W}) group by c.accession, c.location, c.strand, c.pam""",
    "j7_chromosome_names": f"with {FEATURES_SQL} select accession, arg_min(name, feature_row) as name from features where accession is not null group by accession",
    "flt_p12p13_distal": f"{_FULL} select accession, location, strand, pam from sites where location >= {PARAMS.distal_end} and location <= chrom_length - {PARAMS.distal_end} and accession in (select accession from features)",
    "j3_similar_guides": f"{_ASKED}, {_near_sql(PARAMS.edit_distance)} select x.guide, y.guide as other, distance from near join asked x on x.code = a join known y on y.code = b",
    "a5_mismatch_counts": f"{_ASKED}, {_near_sql(CLASSES)}, n as (select a, " + ", ".join(f"count(*) filter (distance = {d}) as n{d}" for d in range(1, CLASSES + 1)) + " from near group by a) select guide, cast(1 as bigint) as mm0, " + ", ".join(f"coalesce(n{d}, 0) as mm{d}" for d in range(1, CLASSES + 1)) + " from asked left join n on a = code",
    "result_neutral_sites": _RESULT,
    "result_zones": f"""{_ZONES}, {_CAND} select c.guide as guide_sequence, c.pam, c.accession,
        case when c.strand = '+' then c.location else c.chrom_length - c.location - {G + P} end as site_location, c.strand, z.zone from cand c left join zones z on z.accession = c.accession and z.low < c.x and c.x < z.high
        where c.accession in (select accession from features) and location >= {PARAMS.distal_end} and location <= chrom_length - {PARAMS.distal_end} and {_FREE}""",
    "m1_rule_scores": f"{_BASE}, w as (select *, {_WINDOW} as w from sites where left_arm is not null and right_arm is not null) select accession, location, strand, pam, w as window, round(1 / (1 + exp(-({RULE_INTERCEPT} + {RULE_LOW_GC} + {_RULES}))), 9) as score from w",
    "f7_self_complementarity": f"""{_BASE} select guide, cast(len([j for j in range(0, {G - 4}) if regexp_matches(substr(guide, j + 1, 4), '[GCS]') and contains(substr({_RC}, 1, {G - 5} - j), substr(guide, j + 1, 4))]) as integer) as stems,
        100.0 * length(regexp_replace(guide, '[^GCS]', '', 'g')) / length(guide) as gc from library""",
    "j9_essential_genes": f"{_ESSENTIAL} select * from essential",
    "w2w5_essential_zones": f"{_ZONES} select accession, low, high, zone from zones",
    "j11_zoned_sites": f"{_ZONES}, {_CAND} select c.accession, c.location, c.strand, z.zone from cand c left join zones z on z.accession = c.accession and z.low < c.x and c.x < z.high",
}
