"""Queries over the gene intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.operators.periods import periods_and_gaps
from sitewright.sources.tables import table


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    genes = table(spark, directory, "gene_features").where(F.col("feature") == "gene")
    genes = genes.select(F.upper(F.trim("accession")).alias("accession"), "start_pos", "stop_pos")
    found = periods_and_gaps(genes, "accession", "start_pos", "stop_pos")
    return found.select(F.col("entity").alias("accession"), "kind", F.col("start").alias("start_pos"), F.col("stop").alias("stop_pos"))


P4_SQL = """
with g as (select distinct upper(trim(accession)) as accession, least(start_pos, stop_pos) as a, greatest(start_pos, stop_pos) as b
           from gene_features where feature = 'gene' and accession is not null and start_pos is not null and stop_pos is not null),
m as (select *, max(b) over (partition by accession order by a, b rows between unbounded preceding and 1 preceding) as before from g),
o as (select *, case when before is null or a > before + 1 then 1 else 0 end as opens from m),
i as (select *, sum(opens) over (partition by accession order by a, b rows between unbounded preceding and current row) as island from o),
p as (select accession, island, min(a) as a, max(b) as b from i group by accession, island)
select accession, 'covered' as kind, a as start_pos, b as stop_pos from p
union all
select accession, 'gap' as kind, before + 1 as start_pos, a - 1 as stop_pos from o where opens = 1 and before is not null
"""

QUERIES = {"p4_found": p4_found}
SQL = {"p4_found": P4_SQL}
