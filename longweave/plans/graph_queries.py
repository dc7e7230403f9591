"""The chunk graph: GR*, AG5, on chunks made coarse so that edges carry weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from longweave.operators import graph
from longweave.plans import views as V
from longweave.plans.catalog import query
from longweave.plans.scalar_queries import _COARSE, coarse

_ADJ = f"SELECT chunk * 1000000 + cluster AS a, NOT is_forward AS a_head, lead(chunk * 1000000 + cluster) OVER w AS b, lead(is_forward) OVER w AS b_head, lead(pos) OVER w - pos - len AS off FROM ({_COARSE}) WINDOW w AS (PARTITION BY read_id ORDER BY idx)"
_BOTH = "SELECT a, a_head, b, b_head, off FROM x WHERE b IS NOT NULL UNION ALL SELECT b, b_head, a, a_head, off FROM x WHERE b IS NOT NULL AND NOT (a = b AND a_head = b_head)"
_WITH = f"WITH RECURSIVE x AS MATERIALIZED ({_ADJ}), e AS MATERIALIZED (SELECT a, a_head, b, b_head, count(*) AS occ, CAST(sum(off) AS BIGINT) AS offsets FROM ({_BOTH}) GROUP BY ALL), g AS MATERIALIZED (SELECT chunk * 1000000 + cluster AS node, count(*) AS occ FROM ({_COARSE}) GROUP BY ALL)"
#: Where a sparse graph is wanted, edges that occur more often than the mean by so many standard deviations.
_SPARSE = 2.5


def parts(spark, sf):
    return graph.build(coarse(spark, sf))


def strong(e):
    """The edges that occur more often than most."""
    least = e.agg(F.avg("occ") + _SPARSE * F.stddev_pop("occ")).first()[0]
    return e.where(F.col("occ") > F.lit(least))


def sparse(spark, sf):
    g, e = parts(spark, sf)
    return g, strong(e)


@query("gr1_build", _WITH + "SELECT * FROM e")
def _(spark, sf):
    return parts(spark, sf)[1]


@query("gr1_tips", f"WITH n AS (SELECT *, chunk * 1000000 + cluster AS node, max(idx) OVER (PARTITION BY read_id) AS l FROM ({_COARSE})) SELECT node, head, count(*) AS n FROM (SELECT node, is_forward AS head FROM n WHERE idx = 0 UNION ALL SELECT node, NOT is_forward FROM n WHERE idx = l) GROUP BY ALL")
def _(spark, sf):
    return graph.tips(coarse(spark, sf))


@query("ag5_edge_representatives", _WITH + """, c AS (SELECT CASE WHEN flip THEN b ELSE a END AS a, CASE WHEN flip THEN b_head ELSE a_head END AS a_head, CASE WHEN flip THEN a ELSE b END AS b, CASE WHEN flip THEN a_head ELSE b_head END AS b_head, off FROM (SELECT *, (b, b_head, a, a_head) < (a, a_head, b, b_head) AS flip FROM x WHERE b IS NOT NULL))
SELECT a, a_head, b, b_head, count(*) AS occ, CAST(list_sort(list(off))[count(*) // 2 + 1] AS BIGINT) AS "offset" FROM c GROUP BY ALL""")  # fmt: skip
def _(spark, sf):
    return graph.representative(coarse(spark, sf))


_DEG = ", d AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY a, a_head) AS degree, max(occ) OVER (PARTITION BY a, a_head) AS most FROM e)"


@query("gr2_light_edges", _WITH + _DEG + ", l AS (SELECT a, a_head, b, b_head FROM d WHERE degree > 1 AND occ <= 2), r AS (SELECT * FROM l UNION SELECT b, b_head, a, a_head FROM l) SELECT a, a_head, b, b_head, occ FROM e ANTI JOIN r USING (a, a_head, b, b_head)")
def _(spark, sf):
    return graph.without_light_edges(parts(spark, sf)[1], 2).select("a", "a_head", "b", "b_head", "occ")


@query("gr2_light_edges_single", _WITH + _DEG + ", f AS (SELECT a AS b, a_head AS b_head, max(occ) AS far FROM e GROUP BY ALL), l AS (SELECT a, a_head, b, b_head FROM d JOIN f USING (b, b_head) WHERE degree > 1 AND occ <= 3 AND far > 3), r AS (SELECT * FROM l UNION SELECT b, b_head, a, a_head FROM l) SELECT a, a_head, b, b_head, occ FROM e ANTI JOIN r USING (a, a_head, b, b_head)")
def _(spark, sf):
    return graph.without_light_edges(parts(spark, sf)[1], 3, retain_single=True).select("a", "a_head", "b", "b_head", "occ")


_COPY = ", ec AS MATERIALIZED (SELECT *, CASE WHEN occ < 3 THEN 0 ELSE 1 END AS copies FROM d), nc AS (SELECT *, CASE WHEN occ < 190 THEN 0 ELSE 1 END AS copies FROM g)"


def copied(spark, sf):
    g, e = parts(spark, sf)
    return g.withColumn("copies", F.when(F.col("occ") < 190, 0).otherwise(1)), e.withColumn("copies", F.when(F.col("occ") < 3, 0).otherwise(1))


@query("gr3_zero_copy_edges", _WITH + _DEG + _COPY + ", w AS (SELECT a, a_head, b, b_head FROM ec WHERE copies = 0 AND occ < 0.5 * most), k AS (SELECT * FROM w INTERSECT SELECT b, b_head, a, a_head FROM w) SELECT a, a_head, b, b_head FROM e ANTI JOIN k USING (a, a_head, b, b_head)")
def _(spark, sf):
    return graph.without_zero_copies(*copied(spark, sf), 0.5)[1].select("a", "a_head", "b", "b_head")


_SP = f", s AS MATERIALIZED (SELECT * FROM e WHERE occ > (SELECT avg(occ) + {_SPARSE} * stddev_pop(occ) FROM e))"
_BALL = ", s1 AS (SELECT DISTINCT a, b FROM s), b1 AS (SELECT node, node AS near FROM g UNION SELECT a, b FROM s1), b2 AS (SELECT * FROM b1 UNION SELECT node, s1.b FROM b1 JOIN s1 ON near = s1.a), m AS (SELECT b2.node, avg(occ) AS mean FROM b2 JOIN g ON near = g.node GROUP BY b2.node)"


@query("gr5_local_coverage", _WITH + _SP + _BALL + "SELECT node, round(mean, 6) AS mean FROM m")
def _(spark, sf):
    return graph.local_coverage(*sparse(spark, sf), 2).select("node", F.round("mean", 6).alias("mean"))


@query("gr5_removable_tips", _WITH + _DEG + _SP + _COPY + _BALL + ", p AS (SELECT a AS node, count(DISTINCT a_head) AS ports FROM s GROUP BY a) SELECT node FROM nc LEFT JOIN p USING (node) JOIN m USING (node) WHERE copies = 0 AND coalesce(ports, 0) < 2 AND occ < 0.99 * mean")
def _(spark, sf):
    g, e = copied(spark, sf)
    return graph.removable_tips(g, strong(e), 0.99, 2)


_COMP = ", r AS (SELECT node, node AS c FROM g UNION SELECT r.node, s.b FROM r JOIN s ON r.c = s.a), k AS (SELECT node, min(c) AS component FROM r GROUP BY node)"


@query("gr9_components", _WITH + _SP + _COMP + "SELECT * FROM k")
def _(spark, sf):
    return graph.components(*sparse(spark, sf))


@query("gr9_sl2_top_components", _WITH + _SP + _COMP + "SELECT component, count(*) AS size FROM k GROUP BY component ORDER BY size DESC, component LIMIT 5")
def _(spark, sf):
    return graph.top_components(*sparse(spark, sf), 5)


@query("gr23_small_components", _WITH + _SP + _COMP + "SELECT node FROM k SEMI JOIN (SELECT component FROM k GROUP BY component HAVING count(*) < 3) USING (component)")
def _(spark, sf):
    return graph.small_components(*sparse(spark, sf), 3)


_SIMPLE = ", q AS (SELECT *, count(*) OVER (PARTITION BY a, a_head) AS d FROM s), f AS (SELECT DISTINCT a AS b, a_head AS b_head, d AS db FROM q), i AS (SELECT a, b FROM q JOIN f USING (b, b_head) WHERE d = 1 AND db = 1 AND a <> b), r AS (SELECT node, node AS c FROM g UNION SELECT r.node, i.b FROM r JOIN i ON r.c = i.a), k AS (SELECT node, min(c) AS path FROM r GROUP BY node)"


@query("gr10_gr11_simple_paths", _WITH + _SP + _SIMPLE + "SELECT * FROM k")
def _(spark, sf):
    return graph.simple_paths(*sparse(spark, sf))


@query("gr10_contracted", _WITH + _SP + _SIMPLE + "SELECT x.path AS path_a, y.path AS path_b, CAST(sum(occ) AS BIGINT) AS occ FROM s JOIN k x ON x.node = a JOIN k y ON y.node = b WHERE x.path <> y.path GROUP BY ALL")
def _(spark, sf):
    return graph.contracted(*sparse(spark, sf))[1]


@query("gr12_starts", _WITH + _SP + "SELECT node, head FROM (SELECT node, unnest([true, false]) AS head FROM g) ANTI JOIN (SELECT DISTINCT a AS node, a_head AS head FROM s) u USING (node, head)")
def _(spark, sf):
    return graph.starts(*sparse(spark, sf))


@query("gr20_transitive_edges", _WITH + _DEG + _COPY + "SELECT DISTINCT ec.a, ec.a_head, ec.b, ec.b_head FROM ec JOIN e y ON y.a = ec.a AND y.a_head = ec.a_head JOIN e z ON z.a = y.b AND z.a_head = NOT y.b_head AND z.b = ec.b AND z.b_head = ec.b_head WHERE copies = 0")
def _(spark, sf):
    return graph.transitive_edges(copied(spark, sf)[1])
