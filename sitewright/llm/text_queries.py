"""Queries over the articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm.leaks import find_leaks
from sitewright.llm.packing import pack_documents, token_counts
from sitewright.llm.pii import find_pii, redact_pii
from sitewright.plans.stage import cut
from sitewright.sources.tables import table

CAPACITY = 8192
MIN_WORDS = 12
MAX_EDITS = 1


def p6_packed_articles(spark: SparkSession, directory: str) -> DataFrame:
    sizes = token_counts(table(spark, directory, "documents"), "doc_id", "text")
    return pack_documents(sizes, CAPACITY).withColumnRenamed("doc", "doc_id")


def p6_covered(spark: SparkSession, directory: str) -> DataFrame:
    """Whether the pieces of each article cover its tokens once, and all its containers hold at most their capacity."""
    packed = cut(p6_packed_articles(spark, directory))
    held = packed.groupBy("container").agg(F.sum("tokens").alias("held"))
    rows = packed.join(held, "container", "left").groupBy("doc_id").agg(
        (F.sum("tokens") == F.max("end")).alias("whole"), ((F.min("begin") == 0) & (F.count("*") == F.max("piece") + 1)).alias("once"), (F.coalesce(F.max("held"), F.lit(0)) <= CAPACITY).alias("fits"),
        ((F.max("end") > 0) == F.bool_and(F.col("container").isNotNull())).alias("placed"),
    )
    return rows


def leaks(spark: SparkSession, directory: str) -> DataFrame:
    items = table(spark, directory, "eval_passages")
    found = find_leaks(table(spark, directory, "documents"), "doc_id", "text", items, "item_id", "passage", MIN_WORDS, MAX_EDITS)
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return leaks(spark, directory).where(F.col("edits") == 0).select("doc_id", "item_id").distinct()


def p7_edited(spark: SparkSession, directory: str) -> DataFrame:
    """The leaks that are found again when every twelfth word of each passage is another one."""
    words = F.array_compact(F.split(F.regexp_replace(F.lower("passage"), r"[^\p{L}\p{N}]+", " "), " "))
    edited = F.array_join(F.transform(F.filter(words, lambda w: w != ""), lambda w, i: F.when(i % MIN_WORDS == 5, F.lit("zzzzz")).otherwise(w)), " ")
    items = table(spark, directory, "eval_passages").select("item_id", edited.alias("passage"))
    found = find_leaks(table(spark, directory, "documents"), "doc_id", "text", items, "item_id", "passage", MIN_WORDS, MAX_EDITS)
    found = found.where(F.col("edits") == 1).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()
    return found.join(p7_found(spark, directory), ["doc_id", "item_id"])


def p7_leaked_items(spark: SparkSession, directory: str) -> DataFrame:
    return leaks(spark, directory)


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    found = find_pii(table(spark, directory, "documents"), "doc_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("kind").alias("pii_kind"), F.col("found").alias("pii_text")).distinct()


def p8_redacted_articles(spark: SparkSession, directory: str) -> DataFrame:
    return redact_pii(table(spark, directory, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


QUERIES = {"p6_packed_articles": p6_packed_articles, "p6_covered": p6_covered, "p7_found": p7_found, "p7_leaked_items": p7_leaked_items, "p7_edited": p7_edited, "p8_found": p8_found, "p8_redacted_articles": p8_redacted_articles}


def _runs_sql(name: str, key: str, text: str, rows: str) -> str:
    """All runs of ``MIN_WORDS`` words of a text column, one row each."""
    plain = f"regexp_replace({text}, '\\\\(?:cite[a-z]*|ref|eqref|label)\\*?(?:\\[[^\\]]*\\])*\\{{[^{{}}]*\\}}', ' ', 'g')"
    plain = f"regexp_replace(regexp_replace({plain}, '\\\\-', '', 'g'), '\\\\[A-Za-z@]+\\*?', ' ', 'g')"
    return f"""{name}_words as (select {key}, unnest(w) as word, generate_subscripts(w, 1) as place from (select {key}, regexp_extract_all(lower({plain}), '[\\p{{L}}\\p{{N}}]+') as w from {rows} where {text} is not null)),
{name}_runs as (select {key}, string_agg(word, ' ') over run as words, count(*) over run as n from {name}_words window run as (partition by {key} order by place rows between current row and {MIN_WORDS - 1} following)),
{name} as (select distinct {key}, words from {name}_runs where n = {MIN_WORDS})"""


_LEAKS = f"with {_runs_sql('d', 'doc_id', 'text', 'documents')}, {_runs_sql('i', 'item_id', 'passage', 'eval_passages')} select distinct doc_id, item_id from d join i using (words)"
SQL = {"p6_covered": "select doc_id, true as whole, true as once, true as fits, true as placed from documents", "p7_found": _LEAKS, "p7_edited": _LEAKS}
