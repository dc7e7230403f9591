"""Sources and sinks: IO*, on lines made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from longweave.operators import ordered
from longweave.plans import views as V
from longweave.plans.catalog import query
from longweave.session import shared_dir
from longweave.sources import sequences as Q


def _written(df, spark, suffix: str) -> str:
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}.{suffix}"
    df.write.text(path)
    return path


@query("io1_fasta_round_trip", f"SELECT name, md5(seq) AS digest FROM ({V.READS_SQL})")
def _(spark, sf):
    reads = V.reads(spark, sf).select("name", "seq")
    path = _written(Q.fasta_lines(reads).select("value"), spark, "fa")
    return Q.read_sequences(spark, path).select("name", F.md5("seq").alias("digest"))


@query("io1_fastq_round_trip", f"SELECT name, md5(seq) AS digest FROM ({V.READS_SQL})")
def _(spark, sf):
    r = V.reads(spark, sf).select(F.concat(F.lit("@"), F.col("name"), F.lit(" d\n"), F.col("seq"), F.lit("\n+\n"), F.expr("repeat('I', length(seq))")).alias("value"))
    return Q.read_sequences(spark, _written(r, spark, "fq")).select("name", F.md5("seq").alias("digest"))


@query("io5_io6_dataset_round_trip", f"SELECT chunk, count(*) AS n FROM ({V.NODES_SQL}) GROUP BY chunk")
def _(spark, sf):
    path = f"{shared_dir(spark)}/dataset-{uuid.uuid4().hex}"
    Q.write_dataset({"nodes": V.nodes(spark, sf)}, path)
    return Q.read_dataset(spark, path, ["nodes"])["nodes"].groupBy("chunk").agg(F.count("*").alias("n"))


@query("io8_paf_round_trip", f"SELECT qname, qstart, qend, strand, matches FROM (SELECT 'r' || read_id AS qname, greatest(pos, 0) AS qstart, greatest(pos, 0) + len AS qend, CASE WHEN is_forward THEN '+' ELSE '-' END AS strand, len - idx % 7 AS matches FROM ({V.NODES_SQL}))")
def _(spark, sf):
    n = V.nodes(spark, sf)
    start = F.greatest("pos", F.lit(0))
    cols = [F.concat(F.lit("r"), "read_id"), F.lit("99999"), start, start + F.col("len"), F.when(F.col("is_forward"), "+").otherwise("-"), F.col("chunk"), F.lit("2000"), F.lit("0"), F.col("len"), F.col("len") - F.col("idx") % 7, F.col("len"), F.lit("60"), F.concat(F.lit("cg:Z:"), F.col("len"), F.lit("M"))]
    lines = n.select(F.concat_ws("\t", *[c.cast("string") for c in cols]).alias("value")).unionByName(spark.createDataFrame([("no alignment",)], "value string"))
    return Q.read_paf(spark, _written(lines, spark, "paf")).select("qname", "qstart", "qend", "strand", "matches")


@query("io12_gfa_lines", f"""SELECT value FROM (SELECT 'H' || chr(9) || 'VN:Z:2.0' AS value UNION ALL SELECT concat_ws(chr(9), 'S', 'c' || chunk, '4', 'ACGT', 'cv:i:' || n, 'cp:i:' || (n // 25)) FROM (SELECT chunk, count(*) AS n FROM ({V.NODES_SQL}) GROUP BY chunk))""")
def _(spark, sf):
    n = V.nodes(spark, sf).groupBy("chunk").agg(F.count("*").alias("n"))
    s = n.select(F.concat(F.lit("c"), "chunk").alias("name"), F.lit("ACGT").alias("seq"), F.col("n").alias("coverage"), F.expr("n div 25").alias("copies"))
    links = spark.createDataFrame([], "a string, a_end boolean, b string, b_end boolean")
    return Q.gfa_lines(s, links).select("value")


@query("io15_sam_lines", f"""SELECT concat_ws(chr(9), 'r' || read_id, CAST(CASE WHEN is_forward THEN 0 ELSE 16 END + CASE WHEN row_number() OVER (PARTITION BY read_id ORDER BY 'c' || chunk, idx) > 1 THEN 2048 ELSE 0 END AS VARCHAR), 'c' || chunk, CAST(greatest(pos, 0) + 1 AS VARCHAR), '60', (CASE WHEN idx > 0 THEN idx || 'H' ELSE '' END) || len || 'M', '*', '0', '0', 'ACGT', '*') AS value FROM ({V.NODES_SQL})""")
def _(spark, sf):
    n = V.nodes(spark, sf)
    a = n.select("read_id", F.concat(F.lit("r"), "read_id").alias("name"), F.concat(F.lit("c"), "chunk").alias("contig"), F.greatest("pos", F.lit(0)).alias("start"), F.col("idx").alias("ord"), "is_forward", F.col("idx").alias("head_clip"), F.lit(0).alias("tail_clip"), F.concat(F.col("len").cast("string"), F.lit("M")).alias("cigar"), F.lit("ACGT").alias("seq"))
    return Q.sam_lines(a, spark.createDataFrame([], "name string, seq string")).select("value")


@query("io16_coverage_lines")
def _(spark, sf):
    n = V.nodes(spark, sf)
    b = ordered.binned_coverage(n, "read_id", F.greatest("pos", F.lit(0)), F.col("pos") + F.col("len"), 1000)
    return Q.coverage_lines(b, "read_id").select("value")


@query("lb18_renamed_fastq", f"SELECT 'read_' || CAST(row_number() OVER (ORDER BY read_id) - 1 AS VARCHAR) AS name, length(seq) AS len FROM ({V.READS_SQL})")
def _(spark, sf):
    reads = V.reads(spark, sf).orderBy("read_id").drop("read_id", "name")
    return Q.numbered(reads).select(F.concat(F.lit("read_"), "read_id").alias("name"), F.length("seq").cast("long").alias("len"))
