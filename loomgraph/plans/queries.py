"""Registered queries of the graph engine over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cells import base_slots, entropy, linear_decay
from ..operators import graph as G
from ..operators import patterns as P
from . import state


def chain(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Consecutive orders of a customer, labelled by the first character of the priority."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    nodes = o.select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("label"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return nodes, o.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst")).where("dst is not null")


NODES = "nodes as (select o_orderkey id, cast(substr(o_orderpriority,1,1) as int) label from orders)"
EDGES = "edges as (select * from (select o_orderkey src, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) dst from orders) where dst is not null), arcs as (select src, dst from edges union select dst, src from edges)"
EGO = "e1 as (select id center, id node, 0 depth from nodes union all select src, dst, 1 from arcs where src<>dst), s2 as (select distinct e.center, a.dst node from e1 e join arcs a on e.node=a.src and e.depth=1), ego as (select * from e1 union all select center, node, 2 from s2 where not exists (select 1 from e1 where e1.center=s2.center and e1.node=s2.node))"
IND = "ind as (select x.center, x.node src, y.node dst, x.depth sdepth, y.depth ddepth from ego x join arcs a on x.node=a.src join ego y on y.center=x.center and y.node=a.dst)"
PRE = f"with {NODES}, {EDGES}, {EGO}, {IND} "


def _with(f):
    def run(spark, sf):
        nodes, edges = chain(spark, sf)
        return f(nodes, G.arcs_of(edges))

    return run


def _label_paths(nodes, arcs):
    return G.outward_paths(nodes, G.ego(nodes, arcs, 2), arcs, 2).withColumn("path", F.array_join("path", ","))


def _compat(nodes, arcs):
    paths = G.outward_paths(nodes, G.ego(nodes, arcs, 1), arcs, 1)
    # Patterns of radius 1 are told apart here by their whole set of paths.
    sets = paths.groupBy("center").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    ids = sets.groupBy("paths").agg(F.min("center").alias("id"))
    return G.compatible(ids.select("id", F.explode("paths").alias("path")))



def _numbered(f):
    """The chain with its edges numbered by their ends, for what depends on the order of edges."""

    def run(spark, sf):
        nodes, edges = chain(spark, sf)
        return f(nodes, P.ordered_arcs(edges.withColumn("seq", F.col("src"))))

    return run


def _patterns(radius):
    return _numbered(lambda n, a: P.extract_patterns(n, a, radius).select("pattern_id", "center_label", "frequency", "center_degree"))


QUERIES = {
    "graph_nodes": _with(lambda n, a: n),
    "graph_arcs": _with(lambda n, a: a),
    "expansion_cap": _with(lambda n, a: G.expansion_cap(n, a)),
    "ego_networks": _with(lambda n, a: G.ego(n, a, 2)),
    "ego_layers": _with(lambda n, a: G.layer_counts(n, a, 2)),
    "induced_arcs": _with(lambda n, a: G.induced(G.ego(n, a, 2), a)),
    "node_degree": _with(lambda n, a: n.join(a.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("c")), "id", "left").select("id", F.coalesce("c", F.lit(0)).alias("degree"))),
    "neighbour_lists": _with(lambda n, a: G.neighbours(n, a).select("id", F.array_join("near", ",").alias("near"))),
    "center_degree": _with(lambda n, a: G.ego(n, a, 1).groupBy("center").agg(F.count_if(F.col("depth") == 1).alias("degree"))),
    "outward_paths": _with(_label_paths),
    "compatible_patterns": _with(_compat),
    "patterns_r1": _patterns(1),
    "patterns_r2": _patterns(2),
    "compatibility_by_radius": _numbered(lambda n, a: P.compatibility(n, a, 2)[0]),
    "compatibility_keys": _numbered(lambda n, a: P.compatibility(n, a, 2)[1]),
    "resource_allocation": _with(lambda n, a: G.resource_allocation(a)),
    "label_entropy": _with(lambda n, a: n.groupBy("label").agg(F.count("*").alias("c")).agg(F.round(entropy(F.array_sort(F.collect_list("c"))), 9).alias("entropy"))),
    "linear_decay": lambda s, sf: s.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.round(linear_decay(F.col("c_acctbal") / 5000), 6).alias("decay")),
    "base_slots": _with(lambda n, a: a.groupBy("src").agg(F.count("*").alias("degree")).withColumn("slots", base_slots(F.col("degree"), F.lit(1000), F.lit(700)).cast("long"))),
}

# A chain's ego is its centre and two arms, so a pattern is a label and an unordered pair of arms.
CHAIN = "l as (select o_orderkey id, o_custkey k, o_orderdate t, cast(substr(o_orderpriority,1,1) as int) l from orders), c as (select id, l, lag(l) over w p1, lag(l,2) over w p2, lead(l) over w n1, lead(l,2) over w n2 from l window w as (partition by k order by t, id)), a1 as (select id, l, coalesce(p1,0) x, coalesce(n1,0) y from c), a2 as (select id, l, coalesce(p1*10+coalesce(p2,0),0) x, coalesce(n1*10+coalesce(n2,0),0) y from c), g1 as (select min(id) id, l, least(x,y) x, greatest(x,y) y, count(*) n from a1 group by l, least(x,y), greatest(x,y)), g2 as (select min(id) id, l, least(x,y) x, greatest(x,y) y, count(*) n from a2 group by l, least(x,y), greatest(x,y))"
DICT = "select id pattern_id, l center_label, n frequency, cast(x>0 as bigint)+cast(y>0 as bigint) center_degree from "
PAIRS = f"with {CHAIN}, p as (select 1 radius, id, l*10+x f, x*10+l b from g1 where x>0 union select 1, id, l*10+y, y*10+l from g1 where y>0 union select 2, id, l*100+x, (x%10)*100+(x//10)*10+l from g2 where x%10>0 union select 2, id, l*100+y, (y%10)*100+(y//10)*10+l from g2 where y%10>0) "

ORACLES = {
    "graph_nodes": PRE + "select * from nodes",
    "graph_arcs": PRE + "select src, dst from edges union all select dst, src from edges",
    "expansion_cap": PRE + "select d p_degree, cast(ceil(d*1.1) as bigint) cap from (select cast(quantile_disc(d,0.9) as bigint) d from (select coalesce(c,0) d from nodes left join (select src, count(*) c from arcs group by 1) on id=src))",
    "ego_networks": PRE + "select * from ego",
    "ego_layers": PRE + "select center, depth, count(*) n_nodes from ego group by all",
    # In a chain, an ego is the orders up to two places away.
    "induced_arcs": "with c as (select o_orderkey id, o_custkey k, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) n from orders) select x.id center, s.id src, d.id dst, cast(abs(s.n-x.n) as int) sdepth, cast(abs(d.n-x.n) as int) ddepth from c x join c s on x.k=s.k and abs(s.n-x.n)<=2 join c d on d.k=x.k and abs(d.n-s.n)=1 and abs(d.n-x.n)<=2",
    "node_degree": PRE + "select id, coalesce(c, 0) degree from nodes left join (select src, count(*) c from arcs group by 1) on id=src",
    "neighbour_lists": PRE + "select id, coalesce(string_agg(cast(dst as varchar), ',' order by dst), '') near from nodes left join (select src, dst from edges union all select dst, src from edges) on id=src group by id",
    "center_degree": PRE + "select id center, (select count(*) from arcs where src=id and dst<>id) degree from nodes",
    "outward_paths": PRE + "select distinct x.center, concat(c.label, ',', m.label, ',', o.label) path from ind x join ind y on x.center=y.center and x.dst=y.src and x.sdepth=0 and x.ddepth=1 and y.ddepth=2 join nodes c on c.id=x.center join nodes m on m.id=x.dst join nodes o on o.id=y.dst",
    "compatible_patterns": PRE + ", p as (select distinct a.src center, c.label*10+o.label p, o.label*10+c.label r from arcs a join nodes c on c.id=a.src join nodes o on o.id=a.dst), k as (select center, list_sort(list(p)) ps from p group by 1), ids as (select min(center) id, ps from k group by ps), u as (select id, unnest(ps) p from ids) select distinct x.id a, y.id b from u x join u y on x.p = (y.p % 10)*10 + y.p//10 where x.id<>y.id",
    "patterns_r1": f"with {CHAIN} {DICT} g1",
    "patterns_r2": f"with {CHAIN} {DICT} g2",
    "compatibility_by_radius": PAIRS + "select distinct u.radius, u.id a, v.id b from p u join p v on u.radius=v.radius and u.f=v.b and u.id<>v.id",
    "compatibility_keys": f"with {CHAIN} select 1 radius, id a from g1 union all select 2, id from g2",
    "resource_allocation": PRE + ", d as (select src m, count(*) deg from arcs group by 1) select x.dst u, y.dst v, round(sum(1.0/deg),6) score from arcs x join arcs y on x.src=y.src and x.dst<y.dst join d on d.m=x.src group by all",
    "label_entropy": PRE + ", c as (select count(*) c from nodes group by label) select round(-sum(c/t*ln(c/t)),9) entropy from c, (select sum(c) t from c)",
    "linear_decay": "select c_custkey, round(least(1.0, greatest(0.0, (1.1 - c_acctbal/5000)/(1.1-1.0))),6) decay from customer",
    "base_slots": PRE + "select src, count(*) degree, cast(least(greatest(1, floor(700*count(*)/1000)), floor((count(*)+1)/2)) as bigint) slots from arcs group by 1",
}

QUERIES |= state.QUERIES
ORACLES |= state.ORACLES
ORACLES["ra_score"] = PAIRS + ", one as (select distinct u.id a, v.id b from p u join p v on u.radius=1 and v.radius=1 and u.f=v.b and u.id<>v.id), n1 as (select a m, count(*) n from one group by 1) select x.a, y.a b, round(sum(1.0/n),9) score from one x join one y on x.b=y.b and x.a<y.a join n1 on n1.m=x.b group by all"
ORACLES["propagate_waves"] = state._wave_sql(PAIRS)
ORACLES["path_classes"] = PAIRS + "select radius, cast(path as int) path, sum(o)::bigint patterns_out, sum(i)::bigint patterns_in from (select radius, f path, 1 o, 0 i from p union all select radius, b, 0, 1 from p) group by all"
