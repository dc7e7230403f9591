"""The driver's tables seen as reads, nodes, clusterings, profiles and CIGARs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Letters a to z as bases, in turn.
BASES = "".join("ACGT"[i % 4] for i in range(26))
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Clusters of the nodes: the event types in order of name.
CLUSTERS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def reads(spark: SparkSession, sf: str) -> DataFrame:
    """read_id, name, seq of the documents' letters."""
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, BASES)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("read_id"), F.concat(F.lit("read_"), F.col("doc_id")).alias("name"), seq.alias("seq"))


READS_SQL = f"SELECT doc_id AS read_id, 'read_' || doc_id AS name, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}') AS seq FROM documents"


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """read_id, idx, node_id, chunk, cluster, is_forward, gap, len, pos: events as encoded nodes.

    A read is a user, its nodes are in order of time. pos sums lengths and gaps of the nodes before.
    """
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    chunk = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("read_id"), (F.row_number().over(own) - 1).alias("idx"), F.col("event_id").alias("node_id"), chunk.alias("chunk"),
        F.coalesce(*[F.when(F.col("event_type") == c, F.lit(i).cast("long")) for i, c in enumerate(CLUSTERS)], F.lit(len(CLUSTERS)).cast("long")).alias("cluster"),
        (F.col("event_id") % 2 == 0).alias("is_forward"), (F.floor("value").cast("long") % 60 - 20).alias("gap"), (chunk + 100).alias("len"), "ts",
    )
    before = Window.partitionBy("read_id").orderBy("ts", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("pos", F.coalesce(F.sum(F.col("len") + F.col("gap")).over(before), F.lit(0).cast("long"))).drop("ts")


NODES_SQL = f"""SELECT read_id, idx, node_id, chunk, cluster, is_forward, gap, len, CAST(coalesce(sum(len + gap) OVER (PARTITION BY read_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM (
SELECT user_id AS read_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx, event_id AS node_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS chunk,
CAST(CASE event_type {' '.join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CLUSTERS))} ELSE {len(CLUSTERS)} END AS BIGINT) AS cluster,
event_id % 2 = 0 AS is_forward, CAST(floor(value) AS BIGINT) % 60 - 20 AS gap, CAST(json_extract_string(props, '$.k') AS BIGINT) + 100 AS len FROM events)"""


def cigars(spark: SparkSession, sf: str) -> DataFrame:
    """node_id, read_id, chunk, cluster, cigar: a CIGAR made up from chunk and place of each node."""
    return nodes(spark, sf).select("node_id", "read_id", "idx", "chunk", "cluster", F.expr("concat(chunk + 1, 'M', idx % 7 + 1, 'D', chunk % 11 + 2, 'I', idx % 5 + 1, 'M', chunk % 3 + 1, 'D', idx % 13 + 4, 'M')").alias("cigar"))


CIGARS_SQL = f"SELECT node_id, read_id, idx, chunk, cluster, concat(chunk + 1, 'M', idx % 7 + 1, 'D', chunk % 11 + 2, 'I', idx % 5 + 1, 'M', chunk % 3 + 1, 'D', idx % 13 + 4, 'M') AS cigar FROM ({NODES_SQL})"


def profile(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, label, xs: embeddings as gains of a read (row) at variants (columns)."""
    return table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("xs"))


PROFILE_SQL = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS xs FROM embeddings"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, label, col (from 0), x: the profile, a row for each cell."""
    return profile(spark, sf).select("vec_id", "label", F.posexplode("xs").alias("col", "x"))


CELLS_SQL = f"SELECT vec_id, label, unnest(range(len(xs))) AS col, unnest(xs) AS x FROM ({PROFILE_SQL})"
