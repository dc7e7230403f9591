"""Sequence files: FASTA, FASTQ, PAF, SAM and GFA read and written, and reads taken in.

Files are read by Spark's text source, so any store it knows will do and large files are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longweave.functions.sequence import cap_homopolymers
from longweave.session import saved


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, desc, seq): one row a record; wrapped lines are joined."""
    text = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    head = F.substring_index("value", "\n", 1)
    seq = F.regexp_replace(F.expr("substr(value, length(substring_index(value, '\\n', 1)) + 1)"), r"\s", "")
    name = F.regexp_extract(head, r"^(\S*)", 1)
    return text.select(name.alias("name"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("desc"), seq.alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, desc, seq): records of four lines; qualities are dropped.

    A file is one unit, as lines tell their kind by their number only: split large runs into files.
    """
    files = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", r"\n+$", ""), "\n")
    records = F.transform(F.sequence(F.lit(0), F.floor(F.size(lines) / 4).cast("int") - 1), lambda i: F.struct(F.substring(F.get(lines, i * 4), 2, 1 << 30).alias("head"), F.get(lines, i * 4 + 1).alias("seq")))
    r = files.where("value <> ''").select(F.explode(records).alias("r"))
    return r.select(F.regexp_extract("r.head", r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace("r.head", r"^\S*", "")).alias("desc"), F.trim(F.col("r.seq")).alias("seq"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """By the last letter of the path: a for FASTA, q for FASTQ; another is a ValueError."""
    if path[-1:] not in ("a", "q"):
        raise ValueError(f"the path ends neither in 'a' (FASTA) nor in 'q' (FASTQ): {path}")
    return (read_fasta if path[-1] == "a" else read_fastq)(spark, path)


def numbered(records: DataFrame) -> DataFrame:
    """``records`` with read_id dense from 0, in the order in which they were read.

    Rows are written once with their partition and place in it; a row for each partition gives the
    offsets. Sequences stay in the JVM.
    """
    placed = saved(records.select(F.spark_partition_id().alias("__part"), (F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias("__at"), "*"), "records")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n"))
    start = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))  # a row for each partition
    return placed.join(F.broadcast(start), "__part").select((F.col("__start") + F.col("__at")).cast("long").alias("read_id"), *records.columns)


def entered(reads: DataFrame, cap: int = 100) -> DataFrame:
    """Reads in upper case with long runs of a base cut down; a base that is none of ACGT is an error."""
    seq = cap_homopolymers(F.upper("seq"), cap)
    checked = F.when(seq.rlike("[^ACGT]"), F.raise_error(F.concat(F.lit("not a base in read "), F.col("read_id").cast("string")))).otherwise(seq)
    return reads.withColumn("seq", checked)


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a PAF file with their CIGAR (cg tag); lines that are none drop out."""
    f = F.split("value", "\t")
    names = ["qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "matches", "block", "mapq"]
    lines = spark.read.text(path).select(f.alias("f"), F.regexp_extract("value", r"\tcg:Z:([^\t]*)", 1).alias("cigar")).where("size(f) >= 12")
    cols = [F.col("f")[i].alias(n) if n in ("qname", "strand", "tname") else F.expr(f"try_cast(f[{i}] AS BIGINT)").alias(n) for i, n in enumerate(names)]
    return lines.select(*cols, "cigar").where("qlen IS NOT NULL AND tend IS NOT NULL AND matches IS NOT NULL")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """(qname, flag, rname, pos, mapq, cigar, seq): records of a SAM file, header lines left out."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("@")).select(f.alias("f")).where("size(f) >= 11")
    return lines.selectExpr("f[0] AS qname", "try_cast(f[1] AS INT) AS flag", "f[2] AS rname", "try_cast(f[3] AS BIGINT) AS pos", "try_cast(f[4] AS INT) AS mapq", "f[5] AS cigar", "f[9] AS seq")


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of a GFA file's segments, or of a FASTA file, by the path's end."""
    if path.endswith("gfa"):
        f = F.split("value", "\t")
        return spark.read.text(path).where(F.col("value").startswith("S\t")).select(f[1].alias("name"), f[2].alias("seq"))
    if path.endswith("a"):
        return read_fasta(spark, path).select("name", "seq")
    raise ValueError(f"neither GFA nor FASTA: {path}")


def gfa_lines(segments: DataFrame, links: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(kind, at, value): lines of a GFA file: header, groups, segments, links, each in order of ``at``.

    segments: (name, seq, coverage, copies); links: (a, a_end, b, b_end) with whether the end is the tail.
    """
    spark = segments.sparkSession
    head = spark.createDataFrame([(0, "", "H\tVN:Z:2.0")], "kind int, at string, value string")
    tags = F.concat_ws("\t", F.concat(F.lit("cv:i:"), F.floor("coverage").cast("string")), F.concat(F.lit("cp:i:"), F.col("copies").cast("long").cast("string")))
    s = segments.select(F.lit(2).alias("kind"), F.col("name").alias("at"), F.concat_ws("\t", F.lit("S"), "name", F.length("seq").cast("string"), "seq", tags).alias("value"))
    end = lambda c, t: F.concat(F.col(c), F.when(F.col(t), "+").otherwise("-"))
    e = links.select(F.lit(3).alias("kind"), F.concat_ws(":", "a", "b").alias("at"), F.concat_ws("\t", F.lit("E"), F.lit("*"), end("a", "a_end"), end("b", "b_end")).alias("value"))
    out = head.unionByName(s).unionByName(e)
    if groups is not None:
        out = out.unionByName(groups.select(F.lit(1).alias("kind"), F.col("name").alias("at"), F.concat_ws("\t", F.lit("U"), "name", F.array_join(F.sort_array("members"), " ")).alias("value")))
    return out


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines sorted by kind and at, written as text; parts follow one another in name order."""
    lines.orderBy("kind", "at", "value").select("value").write.mode("overwrite").text(path)


def sam_lines(alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """(kind, at, value): header and records. Flag 0x10 for reverse, 0x800 if the read came before.

    alignments: (read_id, name, contig, start, ord, is_forward, head_clip, tail_clip, cigar, seq).
    """
    again = F.row_number().over(Window.partitionBy("read_id").orderBy("contig", "ord")) > 1
    flag = F.when(F.col("is_forward"), 0).otherwise(16) + F.when(again, 2048).otherwise(0)
    clip = lambda c: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit("H"))).otherwise("")
    rec = F.concat_ws("\t", "name", flag.cast("string"), "contig", (F.col("start") + 1).cast("string"), F.lit("60"), F.concat(clip("head_clip"), F.col("cigar"), clip("tail_clip")), F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*"))
    head = contigs.select(F.lit(0).alias("kind"), F.col("name").alias("at"), F.concat(F.lit("@SQ\tSN:"), F.col("name"), F.lit("\tLN:"), F.length("seq").cast("string")).alias("value"))
    return head.unionByName(alignments.select(F.lit(1).alias("kind"), F.concat_ws(":", "contig", F.lpad(F.col("start").cast("string"), 12, "0"), "name").alias("at"), rec.alias("value")))


def coverage_lines(binned: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """(kind, at, value): contig, position and mean coverage of each bin, tab-separated."""
    at = F.concat_ws(":", F.col(key).cast("string"), F.lpad(F.col("bin").cast("string"), 12, "0"))
    return binned.select(F.lit(0).alias("kind"), at.alias("at"), F.concat_ws("\t", F.col(key).cast("string"), (F.col("bin") * width).cast("string"), (F.col("covered") / width).cast("string")).alias("value"))


def fasta_lines(contigs: DataFrame) -> DataFrame:
    return contigs.select(F.lit(0).alias("kind"), F.col("name").alias("at"), F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq")).alias("value"))


def write_dataset(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table for each collection below ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def read_dataset(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}
