"""The genome, its features and hits, from the given tables, in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions.sequences import letters
from sitewright.operators.latest import latest_by_key
from sitewright.params import SiteParams
from sitewright.plans.stage import cut
from sitewright.sources.files import without_organelles
from sitewright.sources.tables import table

#: Contigs of the given tables are short, so the distances are too.
PARAMS = SiteParams(seed_length=10, intergenic_space=30, distal_end=60, arm_length=50, density_length=500, edit_distance=4)

BROADCAST_ROWS = 200_000


def genome(spark: SparkSession, directory: str) -> DataFrame:
    """One record (accession, seq, chrom_length) a contig: its latest delivery with any letters, without organelles and
    layout; of deliveries at one time the one with the greatest digest. An empty delivery does not replace an earlier one.

    The delivery is chosen by time and digest and found again by its place in the files, so no sequence is shuffled.
    """
    places = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    records = without_organelles(table(spark, directory, "contigs")).select(F.upper(F.trim("accession")).alias("accession"), "loaded_at", letters(F.col("seq")).alias("seq"), *places)
    known = records.where(F.col("accession").isNotNull() & (F.length("seq") > 0))
    newest = known.groupBy("accession").agg(F.max(F.struct("loaded_at", F.md5("seq").alias("digest"), "file", "row")).alias("m"))
    newest = cut(newest.select("m.file", "m.row"))
    if newest.count() <= BROADCAST_ROWS:  # some 100 bytes each
        newest = F.broadcast(newest)
    return known.join(newest, ["file", "row"], "left_semi").select("accession", "seq", F.length("seq").cast("bigint").alias("chrom_length"))


GENOME_SQL = """
records as (select upper(trim(accession)) as accession, loaded_at, upper(regexp_replace(seq, '[^A-Za-z]', '', 'g')) as seq
            from contigs where not coalesce(regexp_matches(description, 'mitochondrion|plastid|chloroplast'), false)),
newest as (select *, row_number() over (partition by accession order by loaded_at desc nulls last, md5(seq) desc) as rn from records where accession is not null and length(seq) > 0),
genome as (select accession, seq, cast(length(seq) as bigint) as chrom_length from newest where rn = 1)"""


def features(spark: SparkSession, directory: str) -> DataFrame:
    """The feature table, each row's latest delivery, with the names that the search uses."""
    rows = table(spark, directory, "gene_features").where(F.col("assembly_unit") == "Primary Assembly")
    rows = rows.select(
        "feature_row", "loaded_at", "feature", F.col("feature_class").alias("class"), F.col("chromosome").alias("name"), F.upper(F.trim("accession")).alias("accession"),
        F.least("start_pos", "stop_pos").alias("start"), F.greatest("start_pos", "stop_pos").alias("stop"), "strand", F.col("locus_tag").alias("tag"), F.col("product_accession").alias("product"), F.col("start_pos").isNotNull().alias("has_start"), F.col("stop_pos").isNotNull().alias("has_stop"),
    )
    kept = ["feature", "class", "name", "accession", "start", "stop", "strand", "tag", "product", "has_start", "has_stop"]
    return latest_by_key(rows, "feature_row", "loaded_at", kept)


_KEPT = "feature, class, name, accession, start, stop, strand, tag, product, has_start, has_stop"
FEATURES_SQL = f"""
given as (select feature_row, loaded_at, feature, feature_class as class, chromosome as name, upper(trim(accession)) as accession, least(start_pos, stop_pos) as start, greatest(start_pos, stop_pos) as stop,
                 strand, locus_tag as tag, product_accession as product, start_pos is not null as has_start, stop_pos is not null as has_stop
          from gene_features where assembly_unit = 'Primary Assembly'),
delivered as (select *, row_number() over (partition by feature_row order by loaded_at desc nulls last, {', '.join(f'{c} desc nulls last' for c in _KEPT.split(', '))}) as rn from given),
features as (select feature_row, {_KEPT} from delivered where rn = 1 or feature_row is null),
genes as (select accession, start, stop, strand, tag from features where feature = 'gene' and accession is not null and has_start and has_stop)"""


def genes(rows: DataFrame) -> DataFrame:
    """The genes with both coordinates."""
    there = (F.col("feature") == "gene") & F.col("accession").isNotNull() & F.col("has_start") & F.col("has_stop")
    return rows.where(there).select("accession", "start", "stop", "strand", "tag")


def hits(spark: SparkSession, directory: str) -> DataFrame:
    """Stand-in for the output of a similarity search, made of order lines."""
    lines = table(spark, directory, "lineitem")
    query = F.concat(F.lit("XPQ_"), F.lpad(F.col("l_partkey").cast("string"), 8, "0"), F.lit(".1"))
    return lines.select(query.alias("query"), (2 * F.col("l_quantity")).cast("double").alias("pc_identity"), (F.col("l_discount") * 3e-4).cast("double").alias("e_value"))


HITS_SQL = """
hits as (select concat('XPQ_', lpad(cast(l_partkey as varchar), 8, '0'), '.1') as query, cast(2 * l_quantity as double) as pc_identity, cast(l_discount * 3e-4 as double) as e_value from lineitem)"""

_PAMS = ", ".join(f"('{p}')" for p in PARAMS.pams)
_G, _P, _A = PARAMS.guide_length, len(PARAMS.pam), PARAMS.arm_length
SITES_SQL = f"""
strands as (select accession, '+' as strand, seq, chrom_length from genome
            union all select accession, '-', translate(reverse(seq), 'ACGTMRWSYKVHDBN', 'TGCAKYWSRMBDHVN'), chrom_length from genome),
pieces as (select accession, strand, seq, chrom_length, pam, string_split(seq, pam) as parts from strands, (values {_PAMS}) as v(pam)),
numbered as (select accession, strand, pam, unnest(parts) as part, generate_subscripts(parts, 1) as n, len(parts) as most from pieces),
matches as (select accession, strand, pam, n, most, cast(sum(length(part) + {_P}) over (partition by accession, strand, pam order by n) - {_P} - {_G} as bigint) as location from numbered),
sites as (select substr(seq, location + 1, {_G}) as guide, substr(seq, location + {_G} + 1, {_P}) as pam, s.accession, location, s.strand, chrom_length,
                 case when location - {_A} > 0 then substr(seq, location - {_A} + 1, {_A}) end as left_arm,
                 case when location + {_G + _P + _A} < chrom_length then substr(seq, location + {_G + _P} + 1, {_A}) end as right_arm,
                 case when s.strand = '+' then location else chrom_length - location end as x
          from matches m join strands s on m.accession = s.accession and m.strand = s.strand
          where n < most and location >= 0 and location < chrom_length - {_G + _P}),
library as (select guide, count(*) as frequency from sites where not regexp_matches(guide, '[^ACGT]') group by guide),
seeds as (select right(guide, {PARAMS.seed_length}) as seed, count(*) as guides, max(guide) as guide, max(frequency) as frequency from library group by 1),
candidates as (select guide from seeds where guides = 1 and frequency = 1)"""
