from __future__ import annotations

import random
from datetime import datetime

from sitewright.operators.sites import find_sites
from sitewright.params import SiteParams
from sitewright.sources.files import read_fasta, read_features, read_hits, read_result, read_runs, without_organelles, write_fasta, write_result
from sitewright.streaming.arrivals import arriving_contigs, arriving_sites, recent_site_counts, write_new_guides

SMALL = SiteParams(distal_end=50)


def test_fasta(spark, tmp_path):
    (tmp_path / "g.fna").write_text(">c1 some chromosome 1\nacgt\nACGN\n>c2 x mitochondrion\nAAAA\n>c3\r\nTT TT\r\n>c4 empty\n")
    rows = sorted(map(tuple, read_fasta(spark, str(tmp_path / "g.fna")).collect()))
    assert rows == [("c1", "c1 some chromosome 1", "ACGTACGN"), ("c3", "c3", "TTTT"), ("c4", "c4 empty", "")]
    df = spark.createDataFrame([("a", "ACGT"), ("b", None), (None, "A")], "k string, s string")
    write_fasta(df, str(tmp_path / "out"), "k", "s")
    assert [(r.accession, r.seq) for r in read_fasta(spark, str(tmp_path / "out")).collect()] == [("a", "ACGT")]
    named = spark.createDataFrame([("x plastid",), (None,), ("Plastid",)], "description string")
    assert [r.description for r in without_organelles(named).collect()] == [None, "Plastid"]


def test_tables(spark, tmp_path):
    head = "# feature class assembly assembly_unit seq_type chromosome genomic_accession start end strand product_accession non-redundant_refseq related_accession name symbol GeneID locus_tag feature_interval_length product_length attributes".replace("# ", "#_").split()
    row = ["gene", "protein_coding", "A", "Primary Assembly", "chromosome", "I", "NC_1", "5", "90", "+", *[""] * 6, "T1", "86", "", ""]
    (tmp_path / "f.txt").write_text("\t".join(h.replace("#_", "# ") for h in head) + "\n" + "\t".join(row) + "\n")
    found = read_features(spark, str(tmp_path / "f.txt")).first()
    assert (found["# feature"], found.start, found.end, found.locus_tag) == ("gene", 5, 90, "T1")
    (tmp_path / "h.tsv").write_text("q\ts\t55.5\t10\t1\t0\t1\t10\t1\t10\t1e-7\t80\n")
    hit = read_hits(spark, str(tmp_path / "h.tsv")).first()
    assert (hit.query, hit.pc_identity, hit.e_value) == ("q", 55.5, 1e-7)
    for n in "12":
        (tmp_path / f"run{n}.tsv").write_text(f"crRNA\tMismatches\nACGT\t{n}\n")
    runs = read_runs(spark, [str(tmp_path / f"run{n}.tsv") for n in "12"], "crRNA string, Mismatches int")
    assert sorted((r.run, r.Mismatches) for r in runs.collect()) == [("run1.tsv", 1), ("run2.tsv", 2)]


def test_result(spark, tmp_path):
    df = spark.createDataFrame([(1, "chr1", None), (2, None, 5)], "id int, chromosome string, size int")
    write_result(df, str(tmp_path / "r"))
    assert sorted(map(tuple, read_result(spark, str(tmp_path / "r"), "id int, chromosome string, size int").collect())) == [(1, "chr1", None), (2, "nan", 5)]


def contigs(spark, n, seed):
    r = random.Random(seed)
    rows = [(i, f"c{seed}{i}", "x" if i else "x plastid", "".join(r.choice("acgt") for _ in range(600)), 600, datetime(2024, 1, 1 + seed)) for i in range(n)]
    return spark.createDataFrame(rows, "record_id bigint, accession string, description string, seq string, seq_length bigint, loaded_at timestamp")


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    contigs(spark, 3, 1).write.parquet(source)
    query = arriving_sites(arriving_contigs(spark, source), SMALL).writeStream.format("memory").queryName("arrived").start()
    try:
        query.processAllAvailable()
        contigs(spark, 2, 2).write.mode("append").parquet(source)
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(map(tuple, spark.table("arrived").select("accession", "location", "strand", "pam").collect()))
    both = spark.read.parquet(source).where("description = 'x'").selectExpr("accession", "upper(seq) as seq")
    want = find_sites(both, SMALL).where("location >= 50 and location <= chrom_length - 50")
    assert got == sorted(map(tuple, want.select("accession", "location", "strand", "pam").collect())) and {x[0] for x in got} == {"c11", "c12", "c21"}


def test_stream_against_library(spark, tmp_path):
    source, library = str(tmp_path / "in"), str(tmp_path / "library")
    contigs(spark, 2, 3).write.parquet(source)
    sites = arriving_sites(arriving_contigs(spark, source), SMALL)
    still = arriving_sites(spark.read.parquet(source), SMALL)
    known = [r.guide for r in still.select("guide").limit(5).collect()]
    spark.createDataFrame([(g,) for g in known], "guide string").write.parquet(library)
    found = []
    query = write_new_guides(sites, library, lambda df, _: found.extend(r.guide for r in df.collect())).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(found) == sorted(r.guide for r in still.collect() if r.guide not in known)


def test_late_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    for n in (1, 5, 9):
        contigs(spark, 2, n).write.mode("append").parquet(source)
    timed = arriving_contigs(spark, source).select("accession", "loaded_at")
    query = recent_site_counts(timed).writeStream.outputMode("append").format("memory").queryName("counted").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    counted = {(r.begin.day, r.accession): r.sites for r in spark.table("counted").collect()}
    assert counted and all(n == 1 for n in counted.values()) and all(day < 10 for day, _ in counted)
