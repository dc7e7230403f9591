"""The bidirected graph of chunks: building, simplifying and walking it, as tables of nodes and edges.

g_nodes: (node, occ, copies); g_edges: (a, a_head, b, b_head, occ, offsets), each edge in both directions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longweave.operators.components import connected_components
from longweave.operators.ordered import adjacency
from longweave.session import saved

#: Node key from chunk and cluster.
WIDE = 1_000_000


def node_key(chunk, cluster):
    return chunk * WIDE + cluster


def build(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g_nodes, g_edges) of encoded reads: a node leaves by its tail if forward, and is entered by its head."""
    g_nodes = nodes.groupBy(node_key(F.col("chunk"), F.col("cluster")).alias("node")).agg(F.count("*").alias("occ"))
    adj = adjacency(nodes)
    out = adj.select(node_key(F.col("from_chunk"), F.col("from_cluster")).alias("a"), (~F.col("from_forward")).alias("a_head"), node_key(F.col("to_chunk"), F.col("to_cluster")).alias("b"), F.col("to_forward").alias("b_head"), "offset")
    swap = out.select(F.col("b").alias("a"), F.col("b_head").alias("a_head"), F.col("a").alias("b"), F.col("a_head").alias("b_head"), "offset")
    loop = (F.col("a") == F.col("b")) & (F.col("a_head") == F.col("b_head"))
    both = out.unionByName(swap.where(~loop))
    return g_nodes, both.groupBy("a", "a_head", "b", "b_head").agg(F.count("*").alias("occ"), F.sum("offset").alias("offsets"))


def representative(nodes: DataFrame) -> DataFrame:
    """(a, a_head, b, b_head, occ, offset): each canonical edge with the offset of its middle occurrence."""
    adj = adjacency(nodes)
    one = F.struct(node_key(F.col("from_chunk"), F.col("from_cluster")).alias("a"), (~F.col("from_forward")).alias("a_head"), node_key(F.col("to_chunk"), F.col("to_cluster")).alias("b"), F.col("to_forward").alias("b_head"))
    two = F.struct(one["b"].alias("a"), one["b_head"].alias("a_head"), one["a"].alias("b"), one["a_head"].alias("b_head"))
    e = adj.select(F.least(one, two).alias("e"), "offset")
    by = Window.partitionBy("e")
    at = e.withColumn("i", F.row_number().over(by.orderBy("offset")) - 1).withColumn("occ", F.count("*").over(by))
    return at.where(F.col("i") == F.floor(F.col("occ") / 2)).select("e.*", "occ", "offset")


def tips(nodes: DataFrame) -> DataFrame:
    """(node, head, n): reads that begin or end at a port; a read's last node, if forward, ends by its tail."""
    own = Window.partitionBy("read_id")
    e = nodes.withColumn("__last", F.max("idx").over(own)).withColumn("__first", F.min("idx").over(own))
    first = e.where("idx = __first").select(node_key(F.col("chunk"), F.col("cluster")).alias("node"), F.col("is_forward").alias("head"))
    last = e.where("idx = __last").select(node_key(F.col("chunk"), F.col("cluster")).alias("node"), (~F.col("is_forward")).alias("head"))
    return first.unionByName(last).groupBy("node", "head").agg(F.count("*").alias("n"))


def with_degrees(g_edges: DataFrame) -> DataFrame:
    port = Window.partitionBy("a", "a_head")
    return g_edges.withColumn("degree", F.count("*").over(port)).withColumn("most", F.max("occ").over(port))


def without_light_edges(g_edges: DataFrame, threshold: int, retain_single: bool = False) -> DataFrame:
    """Edges but for those of ``threshold`` or fewer occurrences at a port with others.

    With ``retain_single`` such an edge goes only if the far port has an edge above the threshold.
    """
    e = with_degrees(g_edges)
    light = e.where((F.col("degree") > 1) & (F.col("occ") <= threshold))
    if retain_single:
        far = e.groupBy(F.col("a").alias("b"), F.col("a_head").alias("b_head")).agg(F.max("occ").alias("__far"))
        light = light.join(far, ["b", "b_head"]).where(F.col("__far") > threshold)
    gone = light.select("a", "a_head", "b", "b_head")
    gone = gone.unionByName(gone.select(F.col("b").alias("a"), F.col("b_head").alias("a_head"), F.col("a").alias("b"), F.col("a_head").alias("b_head"))).distinct()
    return g_edges.join(gone, ["a", "a_head", "b", "b_head"], "left_anti")


def without_zero_copies(g_nodes: DataFrame, g_edges: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Without edges of no copy that are weak beside the strongest of their port on both sides, and nodes of no copy that are left alone."""
    e = with_degrees(g_edges)
    weak = e.where((F.col("copies") == 0) & (F.col("occ") < threshold * F.col("most"))).select("a", "a_head", "b", "b_head")
    other = weak.select(F.col("b").alias("a"), F.col("b_head").alias("a_head"), F.col("a").alias("b"), F.col("a_head").alias("b_head"))
    gone = weak.intersect(other)
    left = g_edges.join(gone, ["a", "a_head", "b", "b_head"], "left_anti")
    used = left.select(F.col("a").alias("node")).distinct()
    return g_nodes.join(g_nodes.where("copies = 0").join(used, "node", "left_anti").select("node"), "node", "left_anti"), left


def local_coverage(g_nodes: DataFrame, g_edges: DataFrame, depth: int) -> DataFrame:
    """(node, mean): mean occurrence of what lies within ``depth`` edges, itself included."""
    ball = g_nodes.select("node", F.col("node").alias("near"))
    step = g_edges.select(F.col("a").alias("near"), F.col("b").alias("next")).distinct()
    for _ in range(depth):
        ball = ball.unionByName(ball.join(step, "near").select("node", F.col("next").alias("near"))).distinct()
    occ = g_nodes.select(F.col("node").alias("near"), "occ")
    return ball.join(occ, "near").groupBy("node").agg(F.avg("occ").alias("mean"))


def removable_tips(g_nodes: DataFrame, g_edges: DataFrame, threshold: float, depth: int) -> DataFrame:
    """(node): nodes of no copy with a free port that are weak beside what is around them."""
    ports = g_edges.select("a", "a_head").distinct().groupBy(F.col("a").alias("node")).agg(F.count("*").alias("ports"))
    free = g_nodes.where("copies = 0").join(ports, "node", "left").where(F.coalesce("ports", F.lit(0)) < 2)
    return free.join(local_coverage(g_nodes, g_edges, depth), "node").where(F.col("occ") < threshold * F.col("mean")).select("node")


def components(g_nodes: DataFrame, g_edges: DataFrame) -> DataFrame:
    """(node, component): the component is its least node; a node without edges is one by itself."""
    found = connected_components(g_edges, "a", "b")
    return g_nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def top_components(g_nodes: DataFrame, g_edges: DataFrame, n: int) -> DataFrame:
    """(component, size) of the n largest; the least component first on ties."""
    return components(g_nodes, g_edges).groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(n)


def reads_in_components(nodes: DataFrame, n: int) -> DataFrame:
    """Nodes of reads whose every node is in one of the n largest components."""
    g_nodes, g_edges = build(nodes)
    comp = saved(components(g_nodes, g_edges), "components")
    top = comp.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(n)
    keep = comp.join(F.broadcast(top.select("component")), "component", "left_semi").select("node", F.lit(True).alias("__in"))
    per = nodes.withColumn("node", node_key(F.col("chunk"), F.col("cluster"))).join(keep, "node", "left")
    whole = per.groupBy("read_id").agg(F.every(F.coalesce("__in", F.lit(False))).alias("whole")).where("whole").select("read_id")
    return nodes.join(whole, "read_id", "left_semi")


def simple_paths(g_nodes: DataFrame, g_edges: DataFrame) -> DataFrame:
    """(node, path): nodes joined by edges whose ports have no other edge; a path's name is its least node."""
    one = g_edges.withColumn("d", F.count("*").over(Window.partitionBy("a", "a_head")))
    far = one.groupBy(F.col("a").alias("b"), F.col("a_head").alias("b_head")).agg(F.first("d").alias("db"))
    inner = one.where("d = 1").join(far, ["b", "b_head"]).where("db = 1 AND a <> b").select("a", "b")
    return components(g_nodes, inner).withColumnRenamed("component", "path")


def contracted(g_nodes: DataFrame, g_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths: path, n, weight; links: path_a, path_b, occ): the graph with simple paths as nodes."""
    path = saved(simple_paths(g_nodes, g_edges), "paths")
    p = g_nodes.join(path, "node").groupBy("path").agg(F.count("*").alias("n"), F.avg("occ").alias("weight"))
    e = g_edges.join(path.select(F.col("node").alias("a"), F.col("path").alias("path_a")), "a").join(path.select(F.col("node").alias("b"), F.col("path").alias("path_b")), "b")
    return p, e.where("path_a <> path_b").groupBy("path_a", "path_b").agg(F.sum("occ").alias("occ"))


def contracted_ports(g_nodes: DataFrame, g_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: node, path; paths: path, n, occ; links: a, a_head, b, b_head, occ): simple paths as bidirected nodes.

    A path's ends are the ports of its nodes that no edge inside it uses: the lesser one is its head.
    ``occ`` of a path is the rounded mean of its nodes'; links come once, in one direction.
    """
    one = g_edges.withColumn("d", F.count("*").over(Window.partitionBy("a", "a_head")))
    far = one.groupBy(F.col("a").alias("b"), F.col("a_head").alias("b_head")).agg(F.first("d").alias("db"))
    inner = saved(one.where("d = 1").join(far, ["b", "b_head"]).where("db = 1 AND a <> b").select("a", "a_head", "b", "b_head"), "inner")
    members = saved(components(g_nodes, inner).withColumnRenamed("component", "path"), "paths")
    paths = g_nodes.join(members, "node").groupBy("path").agg(F.count("*").alias("n"), F.round(F.avg("occ")).cast("long").alias("occ"))
    ports = members.select("path", "node", F.explode(F.array(F.lit(False), F.lit(True))).alias("head"))
    used = inner.select(F.col("a").alias("node"), F.col("a_head").alias("head"))
    # a path has two ends at most; those of one node are its own head and tail
    ends = ports.join(used, ["node", "head"], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("node", F.desc("head"))))
    ends = saved(ends.select("node", "head", "path", (F.col("r") == 1).alias("side")), "ends")
    of = lambda x: ends.select(F.col("node").alias(x), F.col("head").alias(f"{x}_head"), F.col("path").alias(f"p{x}"), F.col("side").alias(f"s{x}"))
    e = g_edges.join(of("a"), ["a", "a_head"]).join(of("b"), ["b", "b_head"])
    links = e.select(F.col("pa").alias("a"), F.col("sa").alias("a_head"), F.col("pb").alias("b"), F.col("sb").alias("b_head"), "occ")
    return members, paths, links.where("struct(a, a_head) <= struct(b, b_head)")


def starts(g_nodes: DataFrame, g_edges: DataFrame) -> DataFrame:
    """(node, head): ports that nothing leads to, where walks begin."""
    ports = g_nodes.select("node", F.explode(F.array(F.lit(True), F.lit(False))).alias("head"))
    used = g_edges.select(F.col("a").alias("node"), F.col("a_head").alias("head")).distinct()
    return ports.join(used, ["node", "head"], "left_anti")


def transitive_edges(g_edges: DataFrame) -> DataFrame:
    """(a, b): edges of no copy for which there is a way of two edges, through the middle from port to port."""
    x = g_edges.select("a", "a_head", F.col("b").alias("m"), F.col("b_head").alias("m_in"))
    y = g_edges.select(F.col("a").alias("m"), (~F.col("a_head")).alias("m_in"), F.col("b").alias("c"), F.col("b_head").alias("c_head"))
    two = x.join(y, ["m", "m_in"]).select("a", "a_head", F.col("c").alias("b"), F.col("c_head").alias("b_head")).distinct()
    return g_edges.where("copies = 0").join(two, ["a", "a_head", "b", "b_head"], "left_semi").select("a", "a_head", "b", "b_head")


def small_components(g_nodes: DataFrame, g_edges: DataFrame, least: int) -> DataFrame:
    """(node): nodes of components of fewer than ``least`` nodes."""
    comp = saved(components(g_nodes, g_edges), "components")
    small = comp.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") < least)
    return comp.join(small, "component", "left_semi").select("node")


def vertex_cover(edges: list[tuple[int, int]]) -> list[int]:
    """Vertices removed until no edge is left: of most edges first, the greatest of ties. For chunk-sized graphs."""
    near: dict[int, set[int]] = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = []
    while any(near.values()):
        v = max(near, key=lambda x: (len(near[x]), x))
        out.append(v)
        for u in near.pop(v):
            near[u].discard(v)
    return out
