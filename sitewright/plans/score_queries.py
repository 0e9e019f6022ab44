"""Queries of sequence functions, model features and reports over the exported sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions.guides import pack, packed_hamming, usable_guide
from sitewright.functions.scoring import DNA_PAIRS, KELVIN, PAIRS, RNA_PAIRS, SINGLES, bacterial_features, melting_temperature, scaled, single_counts, window_features
from sitewright.functions.sequences import context_window, context_window_5prime, kmers, plain_letters, reverse_complement
from sitewright.operators.latest import latest_by_key
from sitewright.operators.offtarget import histogram_over_runs, mismatch_counts
from sitewright.operators.reports import fitted_line, first_rows, long_form, over_runs, plot_labels, plot_segments, row_statistics, standardised
from sitewright.params import IUPAC
from sitewright.sources.tables import table

_KEPT = [
    "guide", "pam", "accession", "gc_content", "self_complementarity", "site_location", "chromosome", "strand", "chromosome_length", "closest_off_target",
    "intergenic_size", "left_gene", "right_gene", "relative_orientation", "gene_density", "left_hr", "right_hr", "on_target_score", "exported_at",
]


def exported(spark: SparkSession, directory: str) -> DataFrame:
    """The latest export of each site, with its guide in one form and '-' as null."""
    rows = table(spark, directory, "site_output").withColumn("guide", usable_guide(F.col("guide_sequence")))
    missing = {c: F.nullif(F.col(c), F.lit("-")) for c in ("left_gene", "right_gene", "relative_orientation", "left_hr", "right_hr", "closest_off_target", "chromosome")}
    score = F.nanvl("on_target_score", F.lit(None).cast("double"))
    return latest_by_key(rows.withColumns(missing).withColumn("on_target_score", score), "site_id", "exported_at", _KEPT)


_ORDER = ", ".join(f"{c} desc nulls last" for c in _KEPT)
EXPORTED_SQL = f"""
written as (select * replace (nullif(left_gene, '-') as left_gene, nullif(right_gene, '-') as right_gene, nullif(relative_orientation, '-') as relative_orientation, nullif(left_hr, '-') as left_hr,
                   nullif(right_hr, '-') as right_hr, nullif(closest_off_target, '-') as closest_off_target, nullif(chromosome, '-') as chromosome, case when not isnan(on_target_score) then on_target_score end as on_target_score),
            replace(upper(regexp_replace(guide_sequence, '[\\s\\x{{00a0}}]+', '', 'g')), 'U', 'T') as w from site_output),
plain as (select *, case when length(w) = 23 and w like '%GG' then left(w, 20) else w end as p from written),
usable as (select *, case when regexp_full_match(p, '[ACGT]{{20}}') then p end as guide from plain),
placed as (select *, row_number() over (partition by site_id order by exported_at desc nulls last, {_ORDER}) as rn from usable),
exported as (select * from placed where rn = 1 or site_id is null),
sited as (select * from exported where guide is not null)""".replace("{{", "{").replace("}}", "}")
_BASE = f"with {EXPORTED_SQL}"


def _guides(spark: SparkSession, directory: str) -> DataFrame:
    return exported(spark, directory).where(F.col("guide").isNotNull())


def _windows(spark: SparkSession, directory: str) -> DataFrame:
    rows = _guides(spark, directory)
    window = F.concat(F.right(plain_letters(F.col("left_hr")), F.lit(4)), "guide", plain_letters(F.col("pam")), F.left(plain_letters(F.col("right_hr")), F.lit(3)))
    return rows.select("site_id", window.alias("window")).where((F.length("window") == 30) & (F.substr("window", F.lit(26), F.lit(2)) == "GG") & ~F.col("window").rlike("[^ACGT]"))


def reverse_complements(spark: SparkSession, directory: str) -> DataFrame:
    return exported(spark, directory).select("site_id", reverse_complement(F.col("left_hr")).alias("left_rc"), plain_letters(F.col("right_hr")).alias("right_plain"), F.col("left_hr").rlike("[MRWSYKVHDBN]").alias("ambiguous"))


def pair_windows(spark: SparkSession, directory: str) -> DataFrame:
    return _guides(spark, directory).select(F.explode(kmers(F.col("guide"), 2)).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def expanded_guides(spark: SparkSession, directory: str) -> DataFrame:
    """Every plain guide that an ambiguous one can stand for."""
    written = F.translate(F.upper(F.regexp_replace("grna", r"[\s ]+", "")), "U", "T")
    codes = F.create_map(*(F.lit(x) for code, bases in IUPAC.items() for x in (code, bases)))
    given = table(spark, directory, "grna_occurrence").select(written.alias("given")).where(F.col("given").rlike("^[ACGTMRWSYKVHDBN]{20}$") & F.col("given").rlike("[^ACGT]")).distinct()

    def longer(found: Column, code: Column) -> Column:
        bases = F.split(F.element_at(codes, code), "")
        return F.flatten(F.transform(bases, lambda base: F.transform(found, lambda prefix: F.concat(prefix, base))))

    return given.select("given", F.explode(F.aggregate(F.split("given", ""), F.array(F.lit("")), longer)).alias("guide"))


_CODES = ", ".join(f"('{code}', '{base}')" for code, bases in IUPAC.items() if len(bases) > 1 for base in bases)
_EXPAND = f"""
with recursive given as (select distinct replace(upper(regexp_replace(grna, '[\\s\\x{{00a0}}]+', '', 'g')), 'U', 'T') as g from grna_occurrence),
unclear as (select g from given where regexp_full_match(g, '[ACGTMRWSYKVHDBN]{{20}}') and regexp_matches(g, '[^ACGT]')),
codes as (select * from (values {_CODES}) as v(code, base)),
e as (select g as given, g as guide from unclear
      union all select given, regexp_replace(guide, '[^ACGT]', base) from e join codes on code = regexp_extract(guide, '[^ACGT]'))
select given, guide from e where not regexp_matches(guide, '[^ACGT]')
""".replace("{{", "{").replace("}}", "}")


def off_target_distance(spark: SparkSession, directory: str) -> DataFrame:
    parts = F.split("closest_off_target", ",")
    rows = _guides(spark, directory).withColumns({"given": parts[0].cast("int"), "other": usable_guide(parts[1])}).where(F.col("other").isNotNull())
    distance = packed_hamming(pack(F.col("guide")), pack(F.col("other")))
    return rows.select("site_id", "given", distance.cast("int").alias("differing"), F.levenshtein("guide", "other").alias("edits"), F.concat_ws(",", distance.cast("string"), F.col("other")).alias("shown"))


def letter_counts(spark: SparkSession, directory: str) -> DataFrame:
    counts = single_counts(F.col("window"))
    return _windows(spark, directory).select("site_id", *(counts[i].cast("int").alias(f"n_{k.lower()}") for i, k in enumerate(SINGLES)))


def _checksum(values: Column) -> Column:
    return F.aggregate(F.zip_with(values, F.sequence(F.lit(1), F.size(values)), lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)


def feature_sums(spark: SparkSession, directory: str) -> DataFrame:
    """The number of features, and the sum of the places of letters and pairs in their one-hot blocks."""
    rows = _windows(spark, directory).select("site_id", window_features(F.col("window")).alias("f"))
    cut = lambda a, n: _checksum(F.slice("f", a + 1, n)).cast("bigint")
    return rows.select("site_id", F.size("f").alias("features"), cut(0, 120).alias("singles"), cut(124, 464).alias("pairs"), cut(588, 16).alias("pair_counts"), F.element_at("f", 607).cast("bigint").alias("gc"), cut(607, 16).alias("beside"),
        cut(120, 4).alias("single_counts"), F.element_at("f", 605).cast("int").alias("gc_above"), F.element_at("f", 606).cast("int").alias("gc_below"), *(F.round(F.element_at("f", 624 + i), 6).alias(f"tm{i}") for i in range(4)))


def temperatures(spark: SparkSession, directory: str) -> DataFrame:
    rows = _windows(spark, directory)
    guide = F.substr("window", F.lit(5), F.lit(20))
    return rows.select("site_id", F.round(melting_temperature(F.col("window"), 30, RNA_PAIRS), 6).alias("window_tm"), F.round(melting_temperature(guide, 20, DNA_PAIRS), 6).alias("guide_tm"))


def bacterial_sums(spark: SparkSession, directory: str) -> DataFrame:
    rows = _windows(spark, directory).select("site_id", bacterial_features(F.col("window")).alias("f"))
    cut = lambda a, n: _checksum(F.slice("f", a + 1, n)).cast("bigint")
    heat = (F.round(F.element_at("f", 421 + i), 6).alias(f"tm{i}") for i in range(4))
    return rows.select(
        "site_id", F.size("f").alias("features"), cut(0, 80).alias("singles"), cut(80, 4).alias("single_counts"), cut(84, 304).alias("pairs"), cut(388, 16).alias("pair_counts"), cut(404, 16).alias("beside"), *heat, F.round(F.element_at("f", -1), 6).alias("gc"),
    )


def context_windows(spark: SparkSession, directory: str) -> DataFrame:
    """The letters that each kind of scorer looks at."""
    letters = [plain_letters(F.col(c)) for c in ("left_hr", "guide", "pam", "right_hr")]
    windows = {"w28": context_window(*letters, 20, 22), "w30": context_window(*letters, 20), "w32": context_window_5prime(*letters, 20), "w30_of_12": context_window(letters[0], F.right("guide", F.lit(12)), *letters[2:], 12)}
    return _guides(spark, directory).select("site_id", *(w.alias(name) for name, w in windows.items()))


def _known_guides(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "grna_occurrence").select(usable_guide(F.col("grna")).alias("guide")).dropna().distinct()


def off_targets_over_runs(spark: SparkSession, directory: str) -> DataFrame:
    """Off-targets of each class among the counted guides, on average over the exports, a run for each month."""
    runs = _guides(spark, directory).select(F.month("exported_at").alias("run"), "guide").where(F.col("run").isNotNull())
    found = histogram_over_runs(mismatch_counts(runs, _known_guides(spark, directory), 20), "run")
    return found.select("mismatches", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def _tm_sql(seq: str, size: int, pairs: dict) -> str:
    complement = {"A": "T", "T": "A", "C": "G", "G": "C"}
    both = {p: pairs.get(p) or pairs[complement[p[1]] + complement[p[0]]] for p in PAIRS}
    end = lambda w, n: f"(case when {w}({seq}, 1) in ('A', 'T') then {pairs['init_A/T'][n]} else {pairs['init_G/C'][n]} end)"
    total = lambda n: f"({pairs['init'][n]} + {end('left', n)} + {end('right', n)} + {pal(n)} + list_sum([map {{{', '.join(f'{p!r}: {float(v[n])}' for p, v in both.items())}}}[substr({seq}, i, 2)] for i in range(1, {size})]))"
    same = f"{seq} = translate(reverse({seq}), 'ACGT', 'TGCA')"
    pal = lambda n: f"(case when {same} then {pairs['sym'][n]} else 0 end)"
    strands = f"(case when {same} then 25e-9 else 12.5e-9 end)"
    return f"round(1000 * {total(0)} / ({total(1)} + 0.368 * {size - 1} * ln(0.05) + 1.987 * ln({strands})) - {KELVIN}, 6)"


_WINDOWS = f"""{_BASE},
w as (select site_id, right(translate(left_hr, 'MRWSYKVHDBN', 'AAACCGAAACA'), 4) || guide || translate(pam, 'MRWSYKVHDBN', 'AAACCGAAACA') || left(translate(right_hr, 'MRWSYKVHDBN', 'AAACCGAAACA'), 3) as s from sited),
windows as (select * from w where regexp_full_match(s, '[ACGT]{{25}}GG[ACGT]{{3}}'))"""
_PLACE = "(position({x} in 'ATCG'))"


def score_range(spark: SparkSession, directory: str) -> DataFrame:
    return scaled(exported(spark, directory), "on_target_score").select("site_id", F.round("scaled", 9).alias("scaled"))


def standard_scores(spark: SparkSession, directory: str) -> DataFrame:
    rows = exported(spark, directory).select("site_id", F.col("gc_content").alias("gc"), F.col("gene_density").cast("double").alias("density"))
    return standardised(rows, ["gc", "density"]).select("site_id", F.round("gc", 6).alias("gc"), F.round("density", 6).alias("density"))


def labels(spark: SparkSession, directory: str) -> DataFrame:
    return plot_labels(exported(spark, directory))


def segments(spark: SparkSession, directory: str) -> DataFrame:
    return plot_segments(exported(spark, directory))


def bars(spark: SparkSession, directory: str) -> DataFrame:
    wide = table(spark, directory, "lineitem").groupBy("l_returnflag").agg(*(f(c).alias(f"{c}_{n}") for c in ("l_quantity", "l_discount", "l_tax") for n, f in (("mean", F.avg), ("dev", F.stddev_pop))))
    found = long_form(wide, "l_returnflag", [f"{c}_mean" for c in ("l_quantity", "l_discount", "l_tax")], [f"{c}_dev" for c in ("l_quantity", "l_discount", "l_tax")])
    return found.select("l_returnflag", "name", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def triplicates(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"), "l_quantity", "l_discount", "l_tax")
    return row_statistics(rows, "line", ["l_quantity", "l_discount", "l_tax"]).select("line", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def price_lines(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "lineitem").withColumns({"x": F.col("l_quantity").cast("double"), "y": F.col("l_extendedprice").cast("double")})
    return fitted_line(rows, "x", "y", ["l_returnflag"]).select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


def first_sites(spark: SparkSession, directory: str) -> DataFrame:
    rows = exported(spark, directory).where(F.col("accession").isNotNull()).select("accession", "site_location", "site_id", "guide")
    return first_rows(rows, "accession", ["site_location", "site_id"])


def known_contigs(spark: SparkSession, directory: str) -> DataFrame:
    """Accessions that both the sites and the genome have (intersect), with the number of the sites' rows."""
    sites = table(spark, directory, "site_output").select("accession")
    common = sites.intersect(table(spark, directory, "contigs").select("accession"))
    return sites.join(common, "accession").groupBy("accession").agg(F.count("*").alias("n"))


def guides_at_distance(spark: SparkSession, directory: str) -> DataFrame:
    """Distinct guides at each reported distance of the closest other one."""
    rows = _guides(spark, directory).withColumn("mismatches", F.split("closest_off_target", ",")[0].cast("int"))
    return rows.where(F.col("mismatches").isNotNull()).groupBy("mismatches").agg(F.countDistinct("guide").alias("guides"))


def batch_statistics(spark: SparkSession, directory: str) -> DataFrame:
    """Rows of each frequency, on average over the batches."""
    counts = table(spark, directory, "grna_occurrence").where(F.col("frequency") > 0).groupBy("batch_no", "frequency").agg(F.count("*").alias("n"))
    return over_runs(counts, "batch_no", ["frequency"], "n").select("frequency", F.round("mean", 6).alias("mean"), F.round("deviation", 4).alias("deviation"))


QUERIES = {
    "f1f10f11_complements": reverse_complements, "g3_pair_windows": pair_windows, "g1_expanded_guides": expanded_guides, "f14f15_off_target_distance": off_target_distance, "a12_letter_counts": letter_counts,
    "m6_feature_sums": feature_sums, "m12_temperatures": temperatures, "m11_bacterial_features": bacterial_sums, "a8_score_range": score_range, "a9_standard_scores": standard_scores, "v1_plot_labels": labels, "v2_plot_segments": segments,
    "v3_bars": bars, "a10_row_statistics": triplicates, "a11_fitted_lines": price_lines, "a14_first_sites": first_sites, "o6_known_contigs": known_contigs,
    "a7_guides_at_distance": guides_at_distance, "a6_batch_statistics": batch_statistics, "a6_off_targets_over_runs": off_targets_over_runs, "f18_context_windows": context_windows,
}
SQL = {
    "f1f10f11_complements": f"{_BASE} select site_id, translate(reverse(left_hr), 'ACGTMRWSYKVHDBN', 'TGCAKYWSRMBDHVN') as left_rc, translate(right_hr, 'MRWSYKVHDBN', 'AAACCGAAACA') as right_plain, regexp_matches(left_hr, '[MRWSYKVHDBN]') as ambiguous from exported",
    "g3_pair_windows": f"{_BASE}, p as (select unnest([substr(guide, i, 2) for i in range(1, 20)]) as pair from sited) select pair, count(*) as n from p group by pair",
    "g1_expanded_guides": _EXPAND,
    "f14f15_off_target_distance": f"""{_BASE}, o as (select site_id, guide, try_cast(split_part(closest_off_target, ',', 1) as integer) as given, replace(upper(regexp_replace(split_part(closest_off_target, ',', 2), '\\s+', '', 'g')), 'U', 'T') as x from sited),
        q as (select *, case when length(x) = 23 and x like '%GG' then left(x, 20) else x end as other from o)
        select site_id, given, cast(hamming(guide, other) as integer) as differing, cast(levenshtein(guide, other) as integer) as edits, concat(hamming(guide, other), ',', other) as shown from q where regexp_full_match(other, '[ACGT]{{20}}')""".replace("{{", "{").replace("}}", "}"),
    "a12_letter_counts": f"{_WINDOWS} select site_id, " + ", ".join(f"cast(length(s) - length(replace(s, '{k}', '')) as integer) as n_{k.lower()}" for k in SINGLES) + " from windows",
    "m6_feature_sums": f"""{_WINDOWS} select site_id, 627 as features,
        cast(list_sum([4 * (p - 1) + {_PLACE.format(x='substr(s, p, 1)')} for p in range(1, 31)]) as bigint) as singles,
        cast(list_sum([16 * (p - 1) + 4 * ({_PLACE.format(x='substr(s, p, 1)')} - 1) + {_PLACE.format(x='substr(s, p + 1, 1)')} for p in range(1, 30)]) as bigint) as pairs,
        cast(list_sum([4 * ({_PLACE.format(x='substr(s, p, 1)')} - 1) + {_PLACE.format(x='substr(s, p + 1, 1)')} for p in range(1, 30)]) as bigint) as pair_counts,
        cast(length(regexp_replace(substr(s, 5, 20), '[AT]', '', 'g')) as bigint) as gc,
        cast(4 * (position(substr(s, 25, 1) in 'ACGT') - 1) + position(substr(s, 28, 1) in 'ACGT') as bigint) as beside,
        cast(list_sum([{_PLACE.format(x='substr(s, p, 1)')} for p in range(1, 31)]) as bigint) as single_counts,
        cast(length(regexp_replace(substr(s, 5, 20), '[AT]', '', 'g')) > 10 as integer) as gc_above, cast(length(regexp_replace(substr(s, 5, 20), '[AT]', '', 'g')) < 10 as integer) as gc_below,
        {', '.join(f"{_tm_sql(f'substr(s, {1 + a}, {n})', n, RNA_PAIRS)} as tm{i}" for i, (a, n) in enumerate(((0, 30), (19, 5), (11, 8), (6, 5))))} from windows""",
    "m12_temperatures": f"{_WINDOWS} select site_id, {_tm_sql('s', 30, RNA_PAIRS)} as window_tm, {_tm_sql('substr(s, 5, 20)', 20, DNA_PAIRS)} as guide_tm from windows",
    "m11_bacterial_features": f"""{_WINDOWS} select site_id, 425 as features, cast(list_sum([4 * (p - 1) + {_PLACE.format(x='substr(s, p + 4, 1)')} for p in range(1, 21)]) as bigint) as singles,
        cast(list_sum([{_PLACE.format(x='substr(s, p + 4, 1)')} for p in range(1, 21)]) as bigint) as single_counts,
        cast(list_sum([16 * (p - 1) + 4 * ({_PLACE.format(x='substr(s, p + 4, 1)')} - 1) + {_PLACE.format(x='substr(s, p + 5, 1)')} for p in range(1, 20)]) as bigint) as pairs,
        cast(list_sum([4 * ({_PLACE.format(x='substr(s, p + 4, 1)')} - 1) + {_PLACE.format(x='substr(s, p + 5, 1)')} for p in range(1, 20)]) as bigint) as pair_counts,
        cast(4 * (position(substr(s, 25, 1) in 'ACGT') - 1) + position(substr(s, 28, 1) in 'ACGT') as bigint) as beside,
        {', '.join(f"{_tm_sql(f'substr(s, {5 + a}, {n})', n, DNA_PAIRS)} as tm{i}" for i, (a, n) in enumerate(((0, 20), (0, 7), (7, 8), (15, 5))))},
        round(length(regexp_replace(substr(s, 5, 20), '[AT]', '', 'g')) / 20.0, 6) as gc from windows""",
    "a8_score_range": f"{_BASE} select site_id, round((on_target_score - min(on_target_score) over ()) / (max(on_target_score) over () - min(on_target_score) over ()), 9) as scaled from exported",
    "a9_standard_scores": f"{_BASE}, m as (select avg(gc_content) as a, stddev_samp(gc_content) as b, avg(gene_density) as c, stddev_samp(gene_density) as d from exported) select site_id, round((gc_content - a) / b, 6) as gc, round((gene_density - c) / d, 6) as density from exported, m",
    "v1_plot_labels": f"""{_BASE}, k as (select count(distinct chromosome) = count(distinct accession) and count(*) filter (chromosome is null or chromosome = 'nan') = 0 as named from exported),
        l as (select case when named then chromosome else accession end as label, chromosome_length from exported, k) select label, max(chromosome_length) as length from l where label is not null group by label""",
    "v2_plot_segments": f"""{_BASE}, k as (select count(distinct chromosome) = count(distinct accession) and count(*) filter (chromosome is null or chromosome = 'nan') = 0 as named from exported),
        e as (select *, case when named then chromosome else accession end as label from exported, k),
        l as (select label, row_number() over (order by label) - 0.5 as line from (select distinct label from e where label is not null))
        select site_id, label, guide, site_location as x, cast(line - 0.25 as double) as y0, cast(line + 0.25 as double) as y1, concat(coalesce(left_gene, '-'), ',', coalesce(right_gene, '-')) as genes from e join l using (label)""",
    "v3_bars": " union all ".join(f"select l_returnflag, '{c}_mean' as name, round(cast(avg({c}) as double), 6) as mean, round(cast(stddev_pop({c}) as double), 6) as deviation from lineitem group by l_returnflag" for c in ("l_quantity", "l_discount", "l_tax")),
    "a10_row_statistics": "with v as (select concat(l_orderkey, '-', l_linenumber) as line, cast(l_quantity as double) as a, cast(l_discount as double) as b, cast(l_tax as double) as c from lineitem), m as (select *, (a + b + c) / 3 as mean from v) select line, round(mean, 6) as mean, round(sqrt(((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean)) / 3), 6) as deviation from m",
    "a11_fitted_lines": "select l_returnflag, round(regr_slope(cast(l_extendedprice as double), cast(l_quantity as double)), 4) as slope, round(regr_intercept(cast(l_extendedprice as double), cast(l_quantity as double)), 2) as intercept from lineitem group by l_returnflag",
    "a14_first_sites": f"{_BASE}, p as (select accession, site_location, site_id, guide, row_number() over (partition by accession order by site_location nulls first, site_id nulls first, guide) as n from exported where accession is not null) select accession, site_location, site_id, guide from p where n = 1",
    "a7_guides_at_distance": f"{_BASE}, d as (select guide, try_cast(split_part(closest_off_target, ',', 1) as integer) as mismatches from sited) select mismatches, count(distinct guide) as guides from d where mismatches is not null group by mismatches",
    "a6_batch_statistics": """with b as (select distinct batch_no from grna_occurrence where frequency > 0), f as (select distinct frequency from grna_occurrence where frequency > 0),
        c as (select batch_no, frequency, count(*) as n from grna_occurrence where frequency > 0 group by all), g as (select f.frequency, cast(coalesce(c.n, 0) as double) as n from b cross join f left join c on c.batch_no = b.batch_no and c.frequency = f.frequency)
        select frequency, round(avg(n), 6) as mean, round(stddev_pop(n), 4) as deviation from g group by frequency""",
    "f18_context_windows": f"""{_BASE}, q as (select site_id, guide, translate(left_hr, 'MRWSYKVHDBN', 'AAACCGAAACA') as l, translate(pam, 'MRWSYKVHDBN', 'AAACCGAAACA') as m, translate(right_hr, 'MRWSYKVHDBN', 'AAACCGAAACA') as r from sited)
        select site_id, right(l, 2) || guide || m || left(r, 3) as w28, right(l, 4) || guide || m || left(r, 3) as w30, right(l, 1) || m || guide || left(r, 7) as w32, right(l, 12) || right(guide, 12) || m || left(r, 3) as w30_of_12 from q""",
    "a6_off_targets_over_runs": f"""{_BASE}, g as (select distinct replace(upper(regexp_replace(grna, '[\\s\\x{{00a0}}]+', '', 'g')), 'U', 'T') as w from grna_occurrence),
        h as (select case when length(w) = 23 and w like '%GG' then left(w, 20) else w end as p from g), library as materialized (select distinct p as guide from h where regexp_full_match(p, '[ACGT]{{20}}')),
        runs as materialized (select month(exported_at) as run, guide from sited where exported_at is not null), asked as materialized (select distinct guide from runs),
        near as (""".replace("{{", "{").replace("}}", "}") + " union ".join(f"select a.guide, b.guide as other, hamming(a.guide, b.guide) as d from asked a join library b on substr(a.guide, {x}, {n}) = substr(b.guide, {x}, {n}) and hamming(a.guide, b.guide) <= 5" for x, n in ((1, 4), (5, 4), (9, 3), (12, 3), (15, 3), (18, 3)))
    + """), c as (select run, d, count(*) as n from runs join near using (guide) group by all), s as (select run, count(*) as own from runs group by run),
        t as (select s.run, k.range as mismatches, coalesce(c.n, 0) - case when k.range = 0 then own else 0 end as n from s cross join range(6) k left join c on c.run = s.run and c.d = k.range)
        select cast(mismatches as integer) as mismatches, round(avg(n), 6) as mean, round(stddev_pop(n), 6) as deviation from t group by mismatches""",
    "o6_known_contigs": "select accession, count(*) as n from site_output where accession in (select accession from contigs) group by accession",
}
