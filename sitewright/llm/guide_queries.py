"""Queries over guides and genome records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions.guides import pack, unpack, usable_guide
from sitewright.llm.forest import exact_neighbours, nearest_guides
from sitewright.llm.frequent import frequent_items
from sitewright.llm.splitting import split_oversized
from sitewright.llm.termcounts import marked_terms, ngram_counts
from sitewright.operators.latest import latest_by_key
from sitewright.plans.stage import cut
from sitewright.sources.tables import table

MIN_SHARE = 0.002
SIZE_LIMIT = 4000
OVERLAP = 200
NEIGHBOURS = 10
MAX_DIFFERING = 2
ASKED, LEAST_RECALL = 50, 0.9
RARE_TOTAL = 2
COMMON_SHARE = 0.1

_USABLE = """
written as (select *, replace(upper(regexp_replace({guide}, '[\\s\\x{{00a0}}]+', '', 'g')), 'U', 'T') as w from {rows}),
plain as (select *, case when length(w) = 23 and w like '%GG' then left(w, 20) else w end as p from written),
usable as (select *, case when regexp_full_match(p, '[ACGT]{{20}}') then p end as guide from plain)"""


def _usable_sql(guide: str, rows: str) -> str:
    return _USABLE.format(guide=guide, rows=rows)


def hot_guides(spark: SparkSession, directory: str) -> DataFrame:
    scans = table(spark, directory, "grna_occurrence").select("occ_id", "loaded_at", pack(usable_guide(F.col("grna"))).alias("code"))
    return frequent_items(latest_by_key(scans, "occ_id", "loaded_at", ["code"]), "code", MIN_SHARE)


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return hot_guides(spark, directory).select(unpack(F.col("item")).alias("grna"))


def p1_hot_guides(spark: SparkSession, directory: str) -> DataFrame:
    return hot_guides(spark, directory).select(unpack(F.col("item")).alias("grna"), F.col("n").alias("scans"), (F.col("estimate") >= F.col("n")).alias("covered"))


_COUNTING = f"""with {_usable_sql("grna", "grna_occurrence")},
ranked as (select *, row_number() over (partition by occ_id order by loaded_at desc nulls last, guide desc nulls last, frequency desc nulls last, accession desc nulls last) as rn from usable),
counting as (select * from ranked where rn = 1 or occ_id is null)"""

_P1 = f"""{_COUNTING},
n as (select guide as grna, count(*) as scans from counting where guide is not null group by guide),
hot as (select * from n where scans >= {MIN_SHARE} * (select sum(scans) from n))"""
P1_SQL = f"{_P1} select grna from hot"
P1_HOT_SQL = f"{_P1} select grna, scans, true as covered from hot"


def _pieces(spark: SparkSession, directory: str, with_text: bool) -> DataFrame:
    records = table(spark, directory, "contigs").select(F.struct("record_id", "accession").alias("record"), "seq")
    return split_oversized(records, "record", "seq", SIZE_LIMIT, OVERLAP, with_text=with_text)


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return _pieces(spark, directory, False).where(F.col("piece") == 0).select(F.col("item.accession").alias("accession"), "cut_kind").distinct()


def p2_pieces(spark: SparkSession, directory: str) -> DataFrame:
    return _pieces(spark, directory, True).select("item.record_id", "item.accession", "letters", "cut_kind", "piece", "begin", "end", "repeated", "at_gap", "text")


def p2_rejoined(spark: SparkSession, directory: str) -> DataFrame:
    """The pieces of each delivery put together again, without what they repeat, and whether all keep to the limit."""
    records = table(spark, directory, "contigs").select(F.struct("record_id", "accession", F.monotonically_increasing_id().alias("row")).alias("record"), "seq")
    pieces = split_oversized(records, "record", "seq", SIZE_LIMIT, OVERLAP)
    own = F.array_sort(F.collect_list(F.struct("piece", F.substr("text", F.col("repeated") + 1).alias("own"))))  # as much as one row held
    joined = pieces.groupBy("item").agg(own.alias("parts"), F.bool_and((F.length("text") <= SIZE_LIMIT) & (F.col("piece").eqNullSafe(0) | (F.col("repeated") == OVERLAP))).alias("kept"))
    return joined.select("item.record_id", "item.accession", F.md5(F.array_join("parts.own", "")).alias("digest"), "kept")


P2_REJOINED_SQL = f"""with c as (select record_id, accession, upper(regexp_replace(seq, '[^A-Za-z]', '', 'g')) as s from contigs)
select record_id, accession, md5(s) as digest, true as kept from c where length(s) > {SIZE_LIMIT}"""
P2_SQL = f"""
with c as (select distinct accession, upper(regexp_replace(seq, '[^A-Za-z]', '', 'g')) as s from contigs),
l as (select * from c where length(s) > {SIZE_LIMIT})
select distinct accession, case when list_max([length(x) for x in regexp_split_to_array(s, 'N{{10,}}')]) <= {SIZE_LIMIT} then 'gap' else 'inside' end as cut_kind from l
"""


def coded_sites(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "site_output").select("site_id", pack(usable_guide(F.col("guide_sequence"))).alias("code"))


def similar_sites(spark: SparkSession, directory: str, max_distance: int | None = None) -> DataFrame:
    return nearest_guides(coded_sites(spark, directory), "site_id", "code", NEIGHBOURS, max_distance)


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return similar_sites(spark, directory, MAX_DIFFERING).select(F.least("site", "other").alias("site_a"), F.greatest("site", "other").alias("site_b")).distinct()


def p3_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    return similar_sites(spark, directory).select(F.col("site").alias("site_id"), F.col("other").alias("neighbour_id"), F.col("distance").alias("differing"))


def p3_recall(spark: SparkSession, directory: str) -> DataFrame:
    """Of the sites whose id is divisible by 50: how many there are, how many neighbours they should have, and whether at
    least ``LEAST_RECALL`` of these are as near as the exact ones."""
    asked = F.col("site_id") % ASKED == 0
    sites = cut(coded_sites(spark, directory))
    guides = sites.dropna().distinct()
    near = nearest_guides(sites, "site_id", "code", NEIGHBOURS).select(F.col("site").alias("site_id"), F.col("distance").alias("differing")).where(asked).groupBy("site_id").agg(F.array_sort(F.collect_list("differing")).alias("found"))
    ranks = guides.where(asked).select("code").distinct()
    exact = exact_neighbours(ranks, guides.select("code").distinct(), NEIGHBOURS)
    heads = guides.groupBy("code").agg(F.count("*").alias("n"))
    # the distances of a site's neighbours: of its own guide's other sites, and of the sites of the nearest guides
    others = exact.join(heads.withColumnRenamed("code", "right"), "right").select(F.col("left").alias("code"), "distance", F.least("n", F.lit(NEIGHBOURS)).cast("int").alias("n"))
    same = heads.join(ranks, "code").select("code", F.lit(0).alias("distance"), F.least(F.col("n") - 1, F.lit(NEIGHBOURS)).cast("int").alias("n"))
    true = others.unionByName(same).groupBy("code").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.array_repeat("distance", F.col("n"))))), 1, NEIGHBOURS).alias("true"))
    rows = guides.where(asked).groupBy("site_id").agg(F.min("code").alias("code"), F.count("*").alias("guides")).where(F.col("guides") == 1)
    both = rows.join(true, "code").join(near, "site_id", "left")
    right = F.size(F.filter(F.coalesce("found", F.array().cast("array<int>")), lambda d: d <= F.array_max("true")))
    sums = both.agg(F.count("*").alias("sites"), F.coalesce(F.sum(F.size("true")), F.lit(0)).alias("wanted"), F.sum(right).alias("right"))
    return sums.select("sites", "wanted", (F.coalesce("right", F.lit(0)) >= LEAST_RECALL * F.col("wanted")).alias("enough"))


_P3 = f"""with {_usable_sql("guide_sequence", "site_output")},
s as (select distinct site_id, guide from usable where guide is not null and site_id is not null)"""
P3_SQL = f"{_P3} select distinct a.site_id as site_a, b.site_id as site_b from s a join s b on a.site_id < b.site_id and hamming(a.guide, b.guide) <= {MAX_DIFFERING}"
P3_RECALL_SQL = f"""{_P3}, u as (select site_id from s where site_id % {ASKED} = 0 group by site_id having count(*) = 1)
select count(*) as sites, cast(count(*) * least({NEIGHBOURS}, (select count(distinct site_id) from s) - 1) as bigint) as wanted, true as enough from u"""


def guide_counts(spark: SparkSession, directory: str) -> DataFrame:
    scans = table(spark, directory, "grna_occurrence")
    accessions = scans.agg(F.countDistinct("accession").alias("n")).first()["n"]
    rows = scans.select("occ_id", "loaded_at", usable_guide(F.col("grna")).alias("guide"), "frequency", "accession")
    rows = latest_by_key(rows, "occ_id", "loaded_at", ["guide", "frequency", "accession"]).where(F.col("guide").isNotNull() & (F.col("frequency") >= 1))
    counts = ngram_counts(rows.withColumn("terms", F.array("guide")), "accession", "terms", "frequency")
    return marked_terms(counts.withColumn("grna", F.col("ngram")[0]), accessions, RARE_TOTAL, COMMON_SHARE)


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return guide_counts(spark, directory).select("grna", F.explode("marks").alias("mark"))


def p5_guide_frequency(spark: SparkSession, directory: str) -> DataFrame:
    return guide_counts(spark, directory).select("grna", "total", F.col("records").alias("accessions"), F.array_join("marks", ",").alias("marks"))


_P5 = f"""{_COUNTING},
n as (select guide as grna, cast(sum(frequency) as bigint) as total, count(distinct accession) as accessions from counting where guide is not null and frequency >= 1 group by guide),
m as (select *, total <= {RARE_TOTAL} as rare, accessions >= {COMMON_SHARE} * (select count(distinct accession) from grna_occurrence) as common from n)"""
P5_SQL = f"{_P5} select grna, 'rare' as mark from m where rare union all select grna, 'common' as mark from m where common"
P5_FREQUENCY_SQL = f"{_P5} select grna, total, accessions, concat_ws(',', case when rare then 'rare' end, case when common then 'common' end) as marks from m"

QUERIES = {
    "p1_found": p1_found, "p1_hot_guides": p1_hot_guides, "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_rejoined": p2_rejoined, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p3_recall": p3_recall,
    "p5_found": p5_found, "p5_guide_frequency": p5_guide_frequency,
}
SQL = {
    "p1_found": P1_SQL, "p1_hot_guides": P1_HOT_SQL, "p2_found": P2_SQL, "p2_rejoined": P2_REJOINED_SQL, "p3_found": P3_SQL, "p3_recall": P3_RECALL_SQL,
    "p5_found": P5_SQL, "p5_guide_frequency": P5_FREQUENCY_SQL,
}
