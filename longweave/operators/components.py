"""Connected components of an undirected graph, by rounds of hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longweave.operators.joins import salted_join
from longweave.session import drop_saved, saved

#: Vertices up to which a round's table of them is broadcast, 16 bytes each and about as much again for the hash table.
BROADCAST_VERTICES = 1_000_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that ``edges`` names; the component is its least node.

    In each round every vertex hooks onto its least neighbour. That gives trees of two vertices or more
    whose roots are pairs that hook onto each other, the lesser of which stays. Pointers jump to those
    roots by doubling, and the edges are rewritten to them, so the number of vertices at least halves in
    a round and a chain of n takes about log2(n) jumps in whatever order its ids are. Minima are
    pre-aggregated before the shuffle and joins on a vertex with very many neighbours are salted, so it
    is no hot spot. Nothing is gathered on the driver but whether there is more to do.

    Null ends and self loops are left out; repeated edges count once; no edges give no rows.
    """
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    live = saved(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while live.limit(1).count():
        both = live.select(F.col("a").alias("v"), F.col("b").alias("p")).unionByName(live.select(F.col("b").alias("v"), F.col("a").alias("p")))
        hooks = saved(both.groupBy("v").agg(F.min("p").alias("p")), "hooks")
        few = hooks.count() <= BROADCAST_VERTICES
        roots = _rooted(hooks, few)
        if labels is None:
            new = roots.select(F.col("v").alias("node"), F.col("p").alias("component"))
        else:
            found = _looked_up(labels, roots.withColumnsRenamed({"v": "component", "p": "to"}), "component", "node", few)
            new = found.select("node", F.coalesce("to", "component").alias("component"))
        new = saved(new, "labels")
        moved = _looked_up(live, roots.withColumnsRenamed({"v": "a", "p": "ra"}), "a", "b", few)
        moved = _looked_up(moved, roots.withColumnsRenamed({"v": "b", "p": "rb"}), "b", "a", few).where("ra <> rb")
        after = saved(moved.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
        for old in (live, labels, roots):
            if old is not None:
                drop_saved(old)
        live, labels = after, new
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    drop_saved(live)
    return labels


def _looked_up(left: DataFrame, table: DataFrame, key: str, by: str, few: bool) -> DataFrame:
    """``left`` with what ``table``, a row for each vertex, has for ``key``; ``few`` says that it may be broadcast."""
    return left.join(F.broadcast(table), key, "left") if few else salted_join(left, table, key, by, "left")


def _rooted(hooks: DataFrame, few: bool) -> DataFrame:
    """(v, p) with each vertex's root, from (v, p) with its least neighbour."""
    now, first = hooks, True
    while True:
        far = _looked_up(now, now.select(F.col("v").alias("p"), F.col("p").alias("pp")), "p", "v", few)
        to = F.when(F.col("pp") == F.col("v"), F.least("v", "p")).otherwise(F.col("pp")) if first else F.col("pp")
        after = saved(far.select("v", to.alias("p"), (to != F.col("p")).alias("moved")), "jumps")
        drop_saved(now)
        now, first = after.select("v", "p"), False
        now._saved_at = after._saved_at
        if not after.where("moved").limit(1).count():
            return now
