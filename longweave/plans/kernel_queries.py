"""Alignment, clustering, models and copy numbers: AL*, ML*, CP*. Scores have SQL; searches are tested."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from longweave.operators import align, cluster, copies, likelihood
from longweave.plans import views as V
from longweave.plans.catalog import query
from longweave.plans.scalar_queries import _OPS

_POS = f"SELECT node_id, op, n, unnest(range(1, len(n) + 1)) AS i FROM ({_OPS})"


@query("al15_lb8_cigar_differences", f"""SELECT node_id AS key, op[i] AS op, CAST(n[i] AS INTEGER) AS len, CAST(coalesce(list_sum(list_filter(n[1:i - 1], lambda x, k: op[k] <> 'D')), 0) AS INTEGER) AS query, CAST(coalesce(list_sum(list_filter(n[1:i - 1], lambda x, k: op[k] <> 'I')), 0) AS INTEGER) AS reference FROM ({_POS}) WHERE op[i] <> 'M'""")
def _(spark, sf):
    return align.differences(V.cigars(spark, sf).select(F.col("node_id").alias("key"), "cigar")).drop("at")


@query("ml10_highest_gain", f"WITH c AS MATERIALIZED ({V.CELLS_SQL}), b AS (SELECT col FROM c WHERE x > 0 GROUP BY col ORDER BY sum(x) DESC, col DESC LIMIT 1) SELECT vec_id, CAST(x > 0 AS INTEGER) AS cluster FROM c SEMI JOIN b USING (col)")
def _(spark, sf):
    return cluster.highest_gain(V.cells(spark, sf).select("vec_id", "col", "x"))


@query("ml13_exact_score", f"WITH g AS (SELECT label, vec_id, sum(x) AS s FROM ({V.CELLS_SQL}) WHERE col = label GROUP BY ALL) SELECT label, round(sum(greatest(s, 0)), 5) AS score FROM g GROUP BY label")
def _(spark, sf):
    """The exact best score of one column in two clusters."""
    import pyarrow as pa

    def run(key, t):
        gains = t.column("s").to_numpy()[:, None]
        return pa.table({"label": pa.array([key[0].as_py()], t.schema.field("label").type), "score": pa.array([cluster.exact(gains, 2)[1]])})

    g = V.cells(spark, sf).where("col = label").groupBy("label", "vec_id").agg(F.sum("x").alias("s"))
    kind = dict(g.dtypes)["label"]
    return g.groupBy("label").applyInArrow(run, f"label {kind}, score double").select("label", F.round("score", 5).alias("score"))


def _error_rows(spark, sf):
    return V.nodes(spark, sf).select("read_id", "chunk", "cluster", ((F.col("gap") + 20) / 600.0 + F.col("chunk") / 1000.0).alias("error"))


@query("ml1_additive_effects")
def _(spark, sf):
    return cluster.additive_effects(_error_rows(spark, sf))[0]


@query("ml8_ml14_clustered_profiles")
def _(spark, sf):
    """Each label's vectors in two clusters by their eight columns of largest gain."""
    import pyarrow as pa

    def run(key, t):
        rows = sorted(t.to_pylist(), key=lambda r: r["vec_id"])
        x = np.array([r["xs"] for r in rows])
        x = x[:, np.argsort(-np.maximum(x, 0).sum(axis=0))[:8]]
        labels, score = cluster.clustered(x, 2, len(x) / 2, key[0].as_py(), restarts=2, flips=2)
        return pa.table({"vec_id": pa.array([r["vec_id"] for r in rows], pa.int64()), "cluster": pa.array(labels.tolist(), pa.int32()), "score": pa.array([float(score)] * len(rows))})

    return V.profile(spark, sf).groupBy("label").applyInArrow(run, "vec_id long, cluster int, score double")


@query("ml3_expected_gains")
def _(spark, sf):
    """Gains by kind of variant and homopolymer length, a simulation a row."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [(k, h, likelihood.expected_gain(likelihood.Rates(), k, h, trials=10, reads=5)) for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(3)], ["kind", "homopolymer", "gain"])

    grid = spark.createDataFrame([(k, h) for k in ("sub", "ins", "del") for h in (1, 2, 3)], "kind string, homopolymer long")
    return grid.repartition(9).mapInArrow(run, "kind string, homopolymer long, gain double")


@query("cp1_flow_penalty", "SELECT l_suppkey, round(sum(l_linenumber * power(l_quantity - 10.0 * round(l_quantity / 10.0), 2)), 4) AS penalty FROM lineitem GROUP BY l_suppkey")
def _(spark, sf):
    """The penalty of copies rounded from quantities, with line numbers as lengths."""
    import pyarrow as pa

    def run(key, t):
        w = t.column("w").to_numpy()
        return pa.table({"l_suppkey": pa.array([key[0].as_py()], pa.int64()), "penalty": pa.array([copies.penalty(w, t.column("n").to_numpy(), np.floor(w / 10.0 + 0.5), 10.0)])})

    li = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("long").alias("l_suppkey"), F.col("l_quantity").cast("double").alias("w"), F.col("l_linenumber").cast("double").alias("n"))
    return li.groupBy("l_suppkey").applyInArrow(run, "l_suppkey long, penalty double").select("l_suppkey", F.round("penalty", 4).alias("penalty"))


@query("cp1_flow_copies")
def _(spark, sf):
    nodes = [(20.0, 4), (41.0, 6), (19.0, 3), (39.0, 5)]
    edges = [(0, False, 1, True, 20.0), (2, False, 1, True, 21.0), (1, False, 3, True, 40.0)]
    got = copies.estimated(nodes, edges, 20.0)
    return spark.createDataFrame([("node", i, c) for i, c in enumerate(got[0])] + [("edge", i, c) for i, c in enumerate(got[1])], "what string, id int, copies int")


@query("al1_mapped_items")
def _(spark, sf):
    """Items of the benchmark, their letters as bases, found in reads; items too short for eight seeds are in none."""
    letters = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), V.LETTERS, V.BASES)
    chunks = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("chunk"), letters.alias("seq"))
    return align.mapped(V.reads(spark, sf).select("read_id", "seq"), chunks, 0.15, k=15, least=8)


@query("ml19_grouped_consensus")
def _(spark, sf):
    """Consensus of the reads that begin alike."""
    own = V.reads(spark, sf).select(F.substring("seq", 1, 6).alias("head"), "seq")
    return align.grouped_consensus(own, ["head"], least=2)
