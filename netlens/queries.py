"""Registered queries over the star-schema tables, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph as G
from .functions import activity as act
from .operators import build, centrality, communities, components, flow, generate, matrix, paths, report, structure, trees
from .plans.loop import dense_index
from .sources import tables
from .streaming import stream

W = "WITH RECURSIVE "
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ---------------------------------------------------------------- SQL building blocks

INTER = """inter AS (SELECT * FROM (SELECT user_id AS actor, lag(user_id) OVER (PARTITION BY json_extract_string(props, '$.k'), CAST(ts AS DATE) ORDER BY ts, event_id) AS target,
  CASE event_type WHEN 'click' THEN 'comment' WHEN 'view' THEN 'issue_commented' WHEN 'signup' THEN 'review' WHEN 'purchase' THEN 'merge' ELSE 'unknown' END AS type, ts AS created_at, event_id AS ref_id FROM events) WHERE target IS NOT NULL)"""
EDGES = INTER + """, e AS (SELECT actor AS src, target AS dst, CAST(count(*) AS DOUBLE) AS weight FROM inter WHERE actor <> target GROUP BY 1, 2)"""
FREQUENT = INTER + """, fp AS (SELECT least(actor, target) AS u, greatest(actor, target) AS v, CAST(count(*) AS DOUBLE) AS weight FROM inter WHERE actor <> target GROUP BY 1, 2 HAVING count(*) >= 3),
 e AS (SELECT u AS src, v AS dst, weight FROM fp UNION ALL SELECT v, u, weight FROM fp)"""
ACYCLIC = EDGES.replace(", e AS", ", e0 AS") + ", e AS (SELECT * FROM e0 WHERE src < dst)"
TRADE = """e AS (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)"""
SHAPE = """, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), p AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS w FROM e),
 nb AS (SELECT u AS src, w AS dst FROM p UNION ALL SELECT w, u FROM p),
 deg AS (SELECT id, CAST(coalesce(i, 0) AS BIGINT) AS in_degree, CAST(coalesce(o, 0) AS BIGINT) AS out_degree, CAST(coalesce(i, 0) + coalesce(o, 0) AS BIGINT) AS degree FROM v LEFT JOIN (SELECT dst AS id, count(*) AS i FROM e GROUP BY 1) USING (id) LEFT JOIN (SELECT src AS id, count(*) AS o FROM e GROUP BY 1) USING (id)),
 nk AS (SELECT id, coalesce(k, 0) AS k FROM v LEFT JOIN (SELECT src AS id, count(*) AS k FROM nb GROUP BY 1) USING (id)),
 one AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m, (SELECT count(*) FROM p) AS mu)"""
TRIANGLES = """, tri AS (SELECT a.u AS a, a.w AS b, b.w AS c FROM p a JOIN p b ON a.w = b.u JOIN p c ON c.u = a.u AND c.w = b.w),
 corner AS (SELECT a AS id, b AS x, c AS y FROM tri UNION ALL SELECT b, a, c FROM tri UNION ALL SELECT c, a, b FROM tri)"""


def undirected_components(n: int = 12) -> str:
    """CTEs lab0..lab<n>: the smallest label among neighbours, n rounds."""
    out = ", lab0 AS (SELECT id, id AS c FROM v)"
    for i in range(n):
        out += f", lab{i + 1} AS (SELECT id, least(l.c, coalesce(x.c, l.c)) AS c FROM lab{i} l LEFT JOIN (SELECT src AS id, min(k.c) AS c FROM nb JOIN lab{i} k ON k.id = nb.dst GROUP BY 1) x USING (id))"
    return out + f", comp AS (SELECT id, c AS component FROM lab{n})"


def sql_levels(moves: str, sources: str, n: int) -> str:
    """CTEs up to lev(source, id, dist): breadth-first distances of at most n."""
    out = f", l0 AS (SELECT id AS source, id, 0 AS dist FROM ({sources}))"
    for i in range(n):
        out += f", l{i + 1} AS (SELECT * FROM l{i} UNION ALL SELECT source, x AS id, {i + 1} FROM (SELECT DISTINCT l.source, m.dst AS x FROM l{i} l JOIN {moves} m ON m.src = l.id WHERE l.dist = {i}) s WHERE NOT EXISTS (SELECT 1 FROM l{i} o WHERE o.source = s.source AND o.id = s.x))"
    return out + f", lev AS (SELECT * FROM l{n})"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def whole(spark, sf):
    return tables.all_pairs_graph(spark, sf)


def on_both(name: str, f, all_sql: str | None = None, frequent_sql: str | None = None):
    """Registers a query on the graph of all pairs, and as frequent_<name> on that of frequent pairs."""
    register(name, all_sql and W + EDGES + SHAPE + all_sql)(lambda spark, sf: f(whole(spark, sf)))
    register(f"frequent_{name}", frequent_sql and W + FREQUENT + SHAPE + frequent_sql)(lambda spark, sf: f(tables.frequent_graph(spark, sf)))


def r6(c, name=None):
    return F.round(c, 6).alias(name or (c if isinstance(c, str) else "value"))


# ---------------------------------------------------------------- activity


@register("interactions", W + INTER + " SELECT actor, target, type, ref_id FROM inter")
def _(spark, sf):
    return tables.interactions_from_tables(spark, sf).select("actor", "target", "type", "ref_id")


@register("normalized_types", W + INTER + """ SELECT actor, target, CASE lower(trim(type)) WHEN 'comment' THEN 'COMMENT_ON_ISSUE_OR_PR' WHEN 'issue_commented' THEN 'ISSUE_CLOSED_BY_OTHER' WHEN 'review' THEN 'PR_REVIEW_OR_APPROVAL' WHEN 'merge' THEN 'PR_MERGE' END AS type, ref_id FROM inter""")
def _(spark, sf):
    return canonical(spark, sf).select("actor", "target", "type", "ref_id")


def canonical(spark, sf):
    i = tables.interactions_from_tables(spark, sf)
    return i.withColumn("type", act.normalize_type(F.col("type")))


CANON = INTER + """, ci AS (SELECT actor, target, CASE type WHEN 'comment' THEN 'COMMENT_ON_ISSUE_OR_PR' WHEN 'issue_commented' THEN 'ISSUE_CLOSED_BY_OTHER' WHEN 'review' THEN 'PR_REVIEW_OR_APPROVAL' WHEN 'merge' THEN 'PR_MERGE' END AS type, created_at FROM inter)"""


@register("mentions", "SELECT doc_id, m FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '@([A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?)', 1))) AS m FROM documents)")
def _(spark, sf):
    return tables.read(spark, sf, "documents").select("doc_id", F.explode(act.extract_mentions(F.col("text"))).alias("m"))


@register("without_self_pairs", W + INTER + " SELECT actor, target, ref_id FROM inter WHERE actor <> target")
def _(spark, sf):
    return act.drop_self(tables.interactions_from_tables(spark, sf)).select("actor", "target", "ref_id")


@register("recent_interactions", W + INTER + " SELECT type, count(*) AS n FROM inter WHERE created_at >= TIMESTAMP '2025-01-01' - INTERVAL 365 DAY GROUP BY 1")
def _(spark, sf):
    return act.since(tables.interactions_from_tables(spark, sf), "2025-01-01", 1).groupBy("type").agg(F.count("*").alias("n"))


@register("node_sizes", W + EDGES + SHAPE + " SELECT id, round(8 + (degree - (SELECT min(degree) FROM deg)) * 12.0 / greatest(1, (SELECT max(degree) - min(degree) FROM deg)), 6) AS size FROM deg")
def _(spark, sf):
    return act.minmax_scale(G.degrees(whole(spark, sf)), "degree", 8, 20, "size").select("id", r6("size"))


@register("edge_widths", W + EDGES + " SELECT src, dst, round(greatest(0.5, least(4.0, weight * 0.8)), 6) AS width FROM e")
def _(spark, sf):
    return act.clamp_edge_width(whole(spark, sf).edges).select("src", "dst", r6("width"))


@register("circle_layout", W + EDGES + SHAPE + " SELECT id, round(cos(2 * pi() * k / n), 6) + 0.0 AS x, round(sin(2 * pi() * k / n), 6) + 0.0 AS y FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v), one")
def _(spark, sf):
    v = whole(spark, sf).vertices.select("id")
    out = act.circular_positions(dense_index(v, ["id"]), v.count())
    return out.select("id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


# ---------------------------------------------------------------- building and editing


def _simple(types):
    names = ", ".join(f"'{t}'" for t in types)
    return W + CANON + f" SELECT DISTINCT actor AS src, target AS dst, 1.0::DOUBLE AS weight FROM ci WHERE type IN ({names}) AND actor <> target"


for _name, _types in {"comment_graph": [act.COMMENT], "closure_graph": [act.CLOSURE], "review_merge_graph": [act.REVIEW, act.MERGE]}.items():
    register(_name, _simple(_types))(lambda spark, sf, t=_types: build.simple_graph(canonical(spark, sf), t).edges)

register("comment_graph_vertices", W + CANON + f" SELECT actor AS id FROM ci WHERE type = '{act.COMMENT}' UNION SELECT target FROM ci WHERE type = '{act.COMMENT}'")(lambda spark, sf: build.simple_graph(canonical(spark, sf), [act.COMMENT]).vertices.select("id"))


@register("integrated_graph", W + CANON + """ SELECT actor AS src, target AS dst, CAST(sum(CASE type WHEN 'COMMENT_ON_ISSUE_OR_PR' THEN 2 WHEN 'ISSUE_CLOSED_BY_OTHER' THEN 3 WHEN 'PR_REVIEW_OR_APPROVAL' THEN 4 WHEN 'PR_MERGE' THEN 5 ELSE 1 END) AS DOUBLE) AS weight FROM ci WHERE actor <> target GROUP BY 1, 2""")
def _(spark, sf):
    return build.weighted_graph(canonical(spark, sf)).edges


@register("four_graphs", W + CANON + """, t AS (SELECT 'graph1' AS name, actor, target FROM ci WHERE type = 'COMMENT_ON_ISSUE_OR_PR' UNION ALL SELECT 'graph2', actor, target FROM ci WHERE type = 'ISSUE_CLOSED_BY_OTHER' UNION ALL SELECT 'graph3', actor, target FROM ci WHERE type IN ('PR_REVIEW_OR_APPROVAL', 'PR_MERGE') UNION ALL SELECT 'integrated', actor, target FROM ci),
 s AS (SELECT name, actor AS id FROM t UNION SELECT name, target FROM t) SELECT name, (SELECT count(*) FROM s WHERE s.name = x.name) AS vertices, count(*) AS edges FROM (SELECT DISTINCT * FROM t WHERE actor <> target) x GROUP BY name""")
def _(spark, sf):
    out = None
    for name, g in build.build_all_graphs(canonical(spark, sf)).items():
        one = G.vertex_count(g).crossJoin(G.edge_count(g)).select(F.lit(name).alias("name"), F.col("n").alias("vertices"), F.col("m").alias("edges"))
        out = one if out is None else out.union(one)
    return out


@register("shared_vertex_graphs", W + INTER + """, t AS (SELECT actor AS src, target AS dst, CASE type WHEN 'comment' THEN 'comments' WHEN 'issue_commented' THEN 'closures' ELSE 'reviews_merges' END AS name, CASE type WHEN 'comment' THEN 2 WHEN 'issue_commented' THEN 3 WHEN 'review' THEN 4 ELSE 5 END AS w FROM inter WHERE type <> 'unknown' AND actor <> target)
 SELECT name, src, dst, CAST(sum(w) AS DOUBLE) AS weight FROM (SELECT * FROM t UNION ALL SELECT src, dst, 'integrated', w FROM t) GROUP BY 1, 2, 3""")
def _(spark, sf):
    i = tables.interactions_from_tables(spark, sf)
    i = i.withColumn("type", F.when(F.col("type") == "issue_commented", "issue_response").otherwise(F.col("type")))
    out = None
    for name, g in build.build_graphs_shared_vertices(i).items():
        one = g.edges.select(F.lit(name).alias("name"), "src", "dst", "weight")
        out = one if out is None else out.union(one)
    return out


@register("upserted_edges", W + EDGES + ", n AS (SELECT dst AS src, src AS dst, weight * 10 AS weight FROM e WHERE src % 5 = 0) SELECT src, dst, coalesce(n.weight, e.weight) AS weight FROM e FULL JOIN n USING (src, dst)")
def _(spark, sf):
    g = whole(spark, sf)
    new = g.edges.where("src % 5 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") * 10).alias("weight"))
    return G.upsert_edges(g, new).edges


@register("removed_edges", W + EDGES + " SELECT src, dst, weight FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.src = e.dst AND x.dst = e.src AND x.weight >= 2)")
def _(spark, sf):
    g = whole(spark, sf)
    return G.remove_edges(g, g.edges.where("weight >= 2").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).edges


for _kind, _value in {"mean": "avg(weight)", "first": "arg_min(weight, src)"}.items():
    register(f"undirected_{_kind}", W + EDGES + f", x AS (SELECT least(src, dst) AS u, greatest(src, dst) AS w, {_value} AS weight FROM e GROUP BY 1, 2) SELECT u AS src, w AS dst, round(weight, 6) AS weight FROM x UNION ALL SELECT w, u, round(weight, 6) FROM x")(
        lambda spark, sf, k=_kind: G.undirected(whole(spark, sf), k).edges.select("src", "dst", r6("weight"))
    )
register("undirected_mirror", W + EDGES + " SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.src = a.dst AND b.dst = a.src)")(lambda spark, sf: G.undirected(whole(spark, sf), "mirror").edges)
register("induced_subgraph", W + EDGES + " SELECT src, dst, weight FROM e WHERE src % 3 = 0 AND dst % 3 = 0")(lambda spark, sf: (lambda g: G.restrict(g, g.vertices.where("id % 3 = 0")).edges)(whole(spark, sf)))


# ---------------------------------------------------------------- graph API

register("graph_counts", W + EDGES + SHAPE + " SELECT n, m, mu FROM one")(lambda spark, sf: (lambda g: G.vertex_count(g).crossJoin(G.edge_count(g)).crossJoin(G.edge_count(g, False).withColumnRenamed("m", "mu")))(whole(spark, sf)))


@register("edge_probes", W + EDGES + " SELECT e.src, e.dst, x.src IS NOT NULL AS has_edge FROM (SELECT dst AS src, src AS dst FROM e) e LEFT JOIN e x ON x.src = e.src AND x.dst = e.dst")
def _(spark, sf):
    g = whole(spark, sf)
    return G.has_edge(g, g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


register("divergent_pair_counts", W + EDGES + " SELECT src AS id, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS n_pairs FROM e GROUP BY 1")(lambda spark, sf: G.divergent_counts(whole(spark, sf)))
register("convergent_pair_counts", W + EDGES + " SELECT dst AS id, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS n_pairs FROM e GROUP BY 1")(lambda spark, sf: G.convergent_counts(whole(spark, sf)))
register("incident_edges", W + EDGES + " SELECT i.id, src, dst, weight FROM e JOIN (SELECT DISTINCT src AS id FROM e WHERE src % 7 = 0) i ON i.id IN (e.src, e.dst)")(lambda spark, sf: (lambda g: G.incident(g, g.edges.where("src % 7 = 0").select(F.col("src").alias("id"))))(whole(spark, sf)))
register("degrees", W + EDGES + SHAPE + " SELECT * FROM deg")(lambda spark, sf: G.degrees(whole(spark, sf)))
register("degree_sequence", W + EDGES + SHAPE + " SELECT degree, count(*) AS n FROM deg GROUP BY 1")(lambda spark, sf: G.degree_sequence(whole(spark, sf)))
register("neighbor_sets", W + EDGES + " SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbors FROM e GROUP BY 1")(lambda spark, sf: G.neighbors(whole(spark, sf), "out").where(F.size("neighbors") > 0).select("id", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors")))
register("adjacency_lists", W + EDGES + " SELECT src AS id, string_agg(dst || ':' || CAST(weight AS BIGINT), ',' ORDER BY dst) AS adjacent FROM e GROUP BY 1")(lambda spark, sf: G.adjacency_list(whole(spark, sf)).where(F.size("adjacent") > 0).select("id", F.array_join(F.transform("adjacent", lambda x: F.concat_ws(":", x["dst"], x["weight"].cast("long"))), ",").alias("adjacent")))
register("trade_is_complete", W + TRADE + SHAPE + " SELECT n <= 1 OR m = n * (n - 1) AS is_complete FROM one")(lambda spark, sf: G.is_complete(tables.trade_graph(spark, sf)))

# ---------------------------------------------------------------- degrees, density, shape

_DC = {"neighbors": "round(k * 1.0 / greatest(n - 1, 1), 6) FROM nk, one", "total": "round(degree * 1.0 / greatest(n - 1, 1), 6) FROM deg, one", "half": "round(degree * 1.0 / greatest(2 * (n - 1), 1), 6) FROM deg, one"}
for _kind, _tail in _DC.items():
    register(f"degree_centrality_{_kind}", W + EDGES + SHAPE + " SELECT id, " + _tail.replace(" FROM", " AS value FROM"))(lambda spark, sf, k=_kind: centrality.degree_centrality(whole(spark, sf), k).select("id", r6("value")))
register("degree_centrality_in_out", W + EDGES + SHAPE + " SELECT id, in_degree, out_degree, round(in_degree * 1.0 / greatest(n - 1, 1), 6) AS in_value, round(out_degree * 1.0 / greatest(n - 1, 1), 6) AS out_value FROM deg, one")(lambda spark, sf: centrality.degree_centrality(whole(spark, sf), "in_out").select("id", "in_degree", "out_degree", r6("in_value"), r6("out_value")))
register("density", W + EDGES + SHAPE + " SELECT round(m * 1.0 / (n * (n - 1)), 9) AS density FROM one")(lambda spark, sf: structure.density(whole(spark, sf)).select(F.round("density", 9).alias("density")))
register("density_undirected", W + EDGES + SHAPE + " SELECT round(2.0 * mu / (n * (n - 1)), 9) AS density FROM one")(lambda spark, sf: structure.density(whole(spark, sf), False).select(F.round("density", 9).alias("density")))
for _kind, (_x, _y) in {"out_in": ("out_degree", "in_degree"), "total": ("degree", "degree")}.items():
    register(f"assortativity_{_kind}", W + EDGES + SHAPE + f" SELECT round(corr(a.{_x}, b.{_y}), 6) AS assortativity FROM e JOIN deg a ON a.id = src JOIN deg b ON b.id = dst")(lambda spark, sf, k=_kind: structure.assortativity(whole(spark, sf), k).select(r6("assortativity")))
for _kind, _rule in {"source": "in_degree = 0 AND out_degree > 0", "sink": "out_degree = 0 AND in_degree > 0"}.items():
    register(f"{_kind}_vertices", W + ACYCLIC + SHAPE + f" SELECT id FROM deg WHERE {_rule}")(lambda spark, sf, k=_kind: structure.vertices_by_pattern(tables.acyclic_graph(spark, sf), k))
register("isolated_vertices", W + CANON + ", x AS (SELECT actor, target FROM ci WHERE type = 'PR_MERGE') SELECT actor AS id FROM x WHERE actor = target AND NOT EXISTS (SELECT 1 FROM x y WHERE y.actor <> y.target AND x.actor IN (y.actor, y.target)) GROUP BY 1")(lambda spark, sf: structure.vertices_by_pattern(build.simple_graph(canonical(spark, sf), [act.MERGE]), "isolated"))
register("degree_extremes", W + EDGES + SHAPE + " SELECT (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 1) AS max_id, (SELECT max(degree) FROM deg) AS max_degree, (SELECT id FROM deg ORDER BY degree, id LIMIT 1) AS min_id, (SELECT min(degree) FROM deg) AS min_degree, (SELECT count(DISTINCT degree) <= 1 FROM deg) AS is_regular")(lambda spark, sf: (lambda g: structure.degree_extremes(g).crossJoin(structure.is_regular(g)))(whole(spark, sf)))
register("structural_summary", W + EDGES + SHAPE + """, s AS (SELECT n AS vertices, m AS edges, m * 1.0 / (n * (n - 1)) AS density, (SELECT count(DISTINCT degree) <= 1 FROM deg) AS regular, (SELECT count(*) FROM deg WHERE degree = 0) AS isolated, (SELECT count(*) FROM deg WHERE in_degree = 0 AND out_degree > 0) AS sources, (SELECT count(*) FROM deg WHERE out_degree = 0 AND in_degree > 0) AS sinks FROM one)
 SELECT vertices, edges, round(density, 6) AS density, regular, isolated, sources, sinks, CASE WHEN vertices = 0 THEN 'empty' WHEN edges = 0 THEN 'no edges' WHEN density = 1 THEN 'complete' WHEN regular THEN 'regular' WHEN isolated > 0 THEN 'has isolated vertices' WHEN density >= 0.5 THEN 'dense' ELSE 'sparse' END AS topology FROM s""")(
    lambda spark, sf: structure.structural_summary(whole(spark, sf)).select("vertices", "edges", r6("density"), "regular", "isolated", "sources", "sinks", "topology")
)


@register("interpretation", W + EDGES + SHAPE + ", x AS (SELECT m * 1.0 / (n * (n - 1)) AS d, (SELECT corr(a.out_degree, b.in_degree) FROM e JOIN deg a ON a.id = src JOIN deg b ON b.id = dst) AS a FROM one) SELECT CASE WHEN d < 0.01 THEN 'very sparse' WHEN d < 0.1 THEN 'sparse' ELSE 'dense' END AS density, CASE WHEN a > 0.1 THEN 'assortative' WHEN a < -0.1 THEN 'disassortative' ELSE 'neutral' END AS mixing FROM x")
def _(spark, sf):
    g = whole(spark, sf)
    d, a = structure.interpret(F.col("density"), F.col("assortativity"))
    return structure.density(g).crossJoin(structure.assortativity(g)).select(d.alias("density"), a.alias("mixing"))


register("adjacency_matrix", W + EDGES + " SELECT src AS row, dst AS col, weight AS value FROM e")(lambda spark, sf: matrix.adjacency_coo(whole(spark, sf)))
register("laplacian_matrix", W + EDGES + SHAPE + " SELECT id AS row, id AS col, coalesce((SELECT sum(weight) FROM e WHERE src = id), 0.0) AS value FROM v UNION ALL SELECT src, dst, -weight FROM e")(lambda spark, sf: matrix.laplacian_coo(whole(spark, sf)))
register("incidence_matrix", W + EDGES + SHAPE + ", x AS (SELECT u, w, row_number() OVER (ORDER BY u, w) - 1 AS col FROM p) SELECT u AS row, col, 1 AS value FROM x UNION ALL SELECT w, col, 1 FROM x")(lambda spark, sf: matrix.incidence_coo(whole(spark, sf)))

# ---------------------------------------------------------------- triangles and communities

register("triangles", W + EDGES + SHAPE + TRIANGLES + " SELECT count(*) AS triangles FROM tri")(lambda spark, sf: structure.triangles(whole(spark, sf)))
register("transitivity", W + EDGES + SHAPE + TRIANGLES + " SELECT round(3.0 * (SELECT count(*) FROM tri) / (SELECT sum(k * (k - 1) / 2) FROM nk), 6) AS transitivity")(lambda spark, sf: structure.transitivity(whole(spark, sf)).select(r6("transitivity")))
register("clustering", W + EDGES + SHAPE + TRIANGLES + " SELECT id, round(coalesce(t, 0) * 2.0 / greatest(k * (k - 1), 1), 6) AS value FROM nk LEFT JOIN (SELECT id, count(*) AS t FROM corner GROUP BY 1) USING (id)")(lambda spark, sf: structure.clustering(whole(spark, sf)).select("id", r6("value")))
register("clustering_directed", W + EDGES + SHAPE + TRIANGLES + " SELECT id, round(coalesce(t, 0) * 1.0 / greatest(k * (k - 1), 1), 6) AS value FROM nk LEFT JOIN (SELECT c.id, count(*) AS t FROM corner c JOIN e ON (e.src = x AND e.dst = y) OR (e.src = y AND e.dst = x) GROUP BY 1) USING (id)")(lambda spark, sf: structure.clustering(whole(spark, sf), "directed").select("id", r6("value")))
register("average_clustering", W + EDGES + SHAPE + TRIANGLES + " SELECT round(avg(value), 6) AS average_clustering FROM (SELECT coalesce(t, 0) * 2.0 / greatest(k * (k - 1), 1) AS value FROM nk LEFT JOIN (SELECT id, count(*) AS t FROM corner GROUP BY 1) USING (id))")(lambda spark, sf: structure.average_clustering(whole(spark, sf)).select(r6("average_clustering")))
_PLANAR = TRIANGLES + " SELECT CASE WHEN n <= 4 THEN true WHEN mu > 3 * n - 6 THEN false WHEN n = 5 AND mu = 10 THEN false WHEN n = 6 AND mu = 9 AND (SELECT min(k) = 3 AND max(k) = 3 FROM nk) AND (SELECT count(*) FROM tri) = 0 THEN false ELSE true END AS maybe_planar FROM one"
on_both("planarity_screen", structure.planarity_screen, _PLANAR, _PLANAR)

_COMM = ", com AS (SELECT id, id % 7 AS component FROM v)"


def given(g):
    """Communities that SQL can name: by id modulo 7."""
    return g.vertices.select("id", (F.col("id") % 7).alias("component"))


register("modularity", W + EDGES + SHAPE + _COMM + ", t AS (SELECT c.component, sum(k) AS d FROM com c JOIN nk USING (id) GROUP BY 1), l AS (SELECT a.component, count(*) AS l FROM p JOIN com a ON a.id = u JOIN com b ON b.id = w WHERE a.component = b.component GROUP BY 1) SELECT round(sum(coalesce(l, 0) * 1.0 / mu - (d / (2.0 * mu)) ** 2), 6) AS modularity FROM t LEFT JOIN l USING (component), one")(lambda spark, sf: (lambda g: communities.modularity(g, given(g)).select(r6("modularity")))(whole(spark, sf)))
register("modularity_edges_only", W + EDGES + SHAPE + _COMM + " SELECT round(sum((1 - x.degree * y.degree / (2.0 * m)) / (2.0 * m)), 6) AS modularity FROM e JOIN com a ON a.id = src JOIN com b ON b.id = dst JOIN deg x ON x.id = src JOIN deg y ON y.id = dst, one WHERE a.component = b.component")(lambda spark, sf: (lambda g: communities.modularity(g, given(g), "edges_only").select(r6("modularity")))(whole(spark, sf)))
_ENDS = _COMM + " SELECT DISTINCT src AS id FROM nb JOIN com a ON a.id = src JOIN com b ON b.id = dst WHERE a.component <> b.component"
on_both("bridging_ends", lambda g: communities.bridging_ties(g, given(g)), _ENDS, _ENDS)
_COUNTS = _COMM + " SELECT v.id, count(DISTINCT b.component) AS n_communities FROM v JOIN com a USING (id) LEFT JOIN nb ON nb.src = v.id LEFT JOIN com b ON b.id = nb.dst AND b.component <> a.component GROUP BY 1"
on_both("bridging_counts", lambda g: communities.bridging_ties(g, given(g), "count"), _COUNTS, _COUNTS)
register("community_report", W + EDGES + SHAPE + _COMM + " SELECT component, count(*) AS size, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (r <= 8) AS members, greatest(count(*) - 8, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY id) AS r FROM com) GROUP BY 1 ORDER BY size DESC, component LIMIT 10")(
    lambda spark, sf: (lambda g: communities.community_report(given(g)).select("component", "size", F.array_join(F.transform("first_members", lambda x: x.cast("string")), ",").alias("members"), "more"))(whole(spark, sf))
)


@register("community_colors", W + EDGES + SHAPE + _COMM + ", r AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS k FROM com GROUP BY 1) SELECT id, component, ['red', 'green', 'blue'][CAST(k % 3 AS BIGINT) + 1] AS color FROM com JOIN r USING (component)")
def _(spark, sf):
    comm = given(whole(spark, sf))
    sizes = comm.groupBy("component").agg((-F.count("*")).alias("size"))
    return act.community_palette(comm, dense_index(sizes, ["size", "component"], "rank"), ["red", "green", "blue"]).select("id", "component", "color")


# ---------------------------------------------------------------- traversal

#: Searches start from every vertex whose id is divisible by 20, against the whole graph.
_SRC = "SELECT id FROM v WHERE id % 20 = 0"


def some(g, k=20):
    return g.vertices.where(f"id % {k} = 0").select("id")


def sql_order(n: int) -> str:
    """Visit order: within a level by (position of the first parent, id)."""
    out = f", q0 AS (SELECT id AS source, id, 0 AS dist, CAST(NULL AS BIGINT) AS pred, CAST(0 AS BIGINT) AS pos FROM ({_SRC}))"
    for i in range(n):
        out += f", n{i} AS (SELECT q.source, e.dst AS id, min(q.pos) AS ppos, arg_min(q.id, q.pos) AS pred FROM q{i} q JOIN e ON e.src = q.id WHERE q.dist = {i} AND NOT EXISTS (SELECT 1 FROM q{i} o WHERE o.source = q.source AND o.id = e.dst) GROUP BY 1, 2)"
        out += f", q{i + 1} AS MATERIALIZED (SELECT * FROM q{i} UNION ALL SELECT n.source, n.id, {i + 1}, n.pred, c + row_number() OVER (PARTITION BY n.source ORDER BY ppos, n.id) - 1 FROM n{i} n JOIN (SELECT source, count(*) AS c FROM q{i} GROUP BY 1) k ON k.source = n.source)"
    return out + f" SELECT source, id, dist, pred, pos FROM q{n}"


def sql_distances(sources: str, n: int) -> str:
    out = f", d0 AS (SELECT id AS source, id, 0.0::DOUBLE AS dist FROM ({sources}))"
    for i in range(n):
        out += f", d{i + 1} AS (SELECT source, id, min(dist) AS dist FROM (SELECT * FROM d{i} UNION ALL SELECT d.source, e.dst, d.dist + e.weight FROM d{i} d JOIN e ON e.src = d.id) GROUP BY 1, 2)"
    return out


_LEV = " SELECT source, id, dist FROM lev"
on_both("bfs_distances", lambda g: paths.levels(g.edges.select("src", "dst"), some(g)), sql_levels("e", _SRC, 6) + _LEV, sql_levels("e", _SRC, 14) + _LEV)
on_both("bfs_order", lambda g: paths.bfs(g, some(g)), sql_order(6), sql_order(14))
register("reachable", W + ACYCLIC + SHAPE + sql_levels("e", _SRC, 8) + " SELECT source, id FROM lev")(lambda spark, sf: (lambda g: paths.reachable(g, some(g)))(tables.acyclic_graph(spark, sf)))
register("shortest_distances", W + EDGES + SHAPE + sql_distances(_SRC, 8) + " SELECT source, id, dist FROM d8")(lambda spark, sf: (lambda g: paths.sssp(g, some(g)).select("source", "id", "dist"))(whole(spark, sf)))
register("trade_distances", W + TRADE + SHAPE + sql_distances("SELECT id FROM v", 8) + " SELECT source, id, dist FROM d8")(lambda spark, sf: paths.all_pairs(tables.trade_graph(spark, sf)).select("source", "id", "dist"))
_PATH = """, prd AS (SELECT d.id, min(e.src) AS pred FROM d8 d JOIN e ON e.dst = d.id JOIN d8 f ON f.id = e.src AND f.dist + e.weight = d.dist GROUP BY 1),
 bk AS (SELECT max(id) AS id, CAST(max(id) AS VARCHAR) AS path FROM v UNION ALL SELECT p.pred, p.pred || ',' || bk.path FROM bk JOIN prd p ON p.id = bk.id WHERE bk.id <> (SELECT min(id) FROM v))
 SELECT source, d.id AS target, true AS reachable, dist AS distance, path FROM d8 d JOIN bk ON bk.id = d.source WHERE d.id = (SELECT max(id) FROM v)"""


def first_to_last(g):
    """The path from the smallest id to the largest, its vertices as text."""
    a, b = g.vertices.agg(F.min("id"), F.max("id")).first()
    return paths.shortest_path(g, a, b).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ","))


register("shortest_path", W + EDGES + SHAPE + sql_distances("SELECT min(id) AS id FROM v", 8) + _PATH)(lambda spark, sf: first_to_last(whole(spark, sf).saved()))
register("bellman_ford", W + ACYCLIC.replace("SELECT * FROM e0 WHERE", "SELECT src, dst, weight - 3 AS weight FROM e0 WHERE weight <> 3 AND") + SHAPE + sql_distances("SELECT min(id) AS id FROM v", 60) + " SELECT source, id, dist FROM d60")(lambda spark, sf: (lambda g: paths.bellman_ford(g, g.vertices.agg(F.min("id").alias("id")))[0].select("source", "id", "dist"))(G.graph(tables.acyclic_graph(spark, sf).edges.select("src", "dst", (F.col("weight") - 3).alias("weight")))))


def _topo(n: int = 150) -> str:
    return W + ACYCLIC + SHAPE + ", lv AS (SELECT id, 0 AS level FROM v UNION SELECT e.dst, lv.level + 1 FROM lv JOIN e ON e.src = lv.id) SELECT id, max(level) AS level FROM lv GROUP BY 1"


register("topological_levels", _topo())(lambda spark, sf: paths.topological_levels(tables.acyclic_graph(spark, sf)).select("id", "level"))
_FAR = " SELECT max(dist) AS max_distance, round(avg(dist), 6) AS mean_distance FROM lev WHERE dist > 0"
on_both("distance_stats", lambda g: paths.distance_stats(g).select("max_distance", r6("mean_distance")), sql_levels("nb", "SELECT id FROM v", 5) + _FAR, sql_levels("nb", "SELECT id FROM v", 14) + _FAR)

# ---------------------------------------------------------------- connectivity and trees

on_both("components", components.connected_components, undirected_components(6) + " SELECT id, component FROM comp", undirected_components() + " SELECT id, component FROM comp")
register("graph_info", W + EDGES + SHAPE + undirected_components(6) + " SELECT 'all' AS name, n AS vertices, m AS edges, (SELECT count(DISTINCT component) <= 1 FROM comp) AS is_connected, m = n * (n - 1) AS is_complete, m = 0 AS is_empty FROM one")(lambda spark, sf: structure.graph_info(whole(spark, sf), "all"))
_RC = ", rc AS (SELECT id AS a, id AS b FROM v UNION SELECT rc.a, e.dst FROM rc JOIN e ON e.src = rc.b) SELECT x.a AS id, min(x.b) AS component FROM rc x JOIN rc y ON x.a = y.b AND x.b = y.a GROUP BY 1"
register("strong_components", W + EDGES + SHAPE + _RC)(lambda spark, sf: components.scc(whole(spark, sf)))
register("repeated_strong_components", W + EDGES.replace(", e AS", ", e0 AS") + ", e AS (SELECT * FROM e0 WHERE weight >= 4)" + SHAPE + _RC)(lambda spark, sf: components.scc(G.graph(whole(spark, sf).edges.where("weight >= 4"))))
_PARITY = ", wk AS (SELECT id AS root, id, 0 AS par FROM v UNION SELECT wk.root, nb.dst, 1 - wk.par FROM wk JOIN nb ON nb.src = wk.id) SELECT NOT EXISTS (SELECT 1 FROM wk WHERE root = id AND par = 1) AS is_bipartite"
on_both("bipartite", components.is_bipartite, _PARITY, _PARITY)


_ORDERED = "e AS (SELECT DISTINCT o_custkey AS src, CAST(-1 - l_suppkey AS BIGINT) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@register("order_graph_bipartite", W + _ORDERED + SHAPE + ", r AS (SELECT min(id) AS id FROM v), wk AS (SELECT id, 0 AS par FROM r UNION SELECT nb.dst, 1 - wk.par FROM wk JOIN nb ON nb.src = wk.id) SELECT count(*) = count(DISTINCT id) AS is_bipartite FROM wk")
def _(spark, sf):
    lines = tables.read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    orders = tables.read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    e = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"))
    return components.is_bipartite(G.graph(e))


def sql_blocks(n: int) -> str:
    """Two pairs are in one block if no single vertex x parts them: they lie in the same components of the graph without x, for every x."""
    out = ", m0 AS MATERIALIZED (SELECT x.id AS x, v.id, v.id AS c FROM v x JOIN v ON v.id <> x.id)"
    for i in range(n):
        out += f", m{i + 1} AS MATERIALIZED (SELECT m.x, m.id, least(m.c, coalesce(min(k.c), m.c)) AS c FROM m{i} m LEFT JOIN nb ON nb.src = m.id LEFT JOIN m{i} k ON k.x = m.x AND k.id = nb.dst GROUP BY m.x, m.id, m.c)"
    out += f", side AS (SELECT u, w, m.x, m.c FROM p JOIN m{n} m ON m.id = u UNION ALL SELECT u, w, m.x, m.c FROM p JOIN m{n} m ON m.id = w AND m.x = u), sig AS MATERIALIZED (SELECT u, w, string_agg(c || '', ',' ORDER BY x) AS s FROM side GROUP BY 1, 2)"
    return out + " SELECT u, w AS v, (min((u, w)) OVER (PARTITION BY s))[1] AS block_u, (min((u, w)) OVER (PARTITION BY s))[2] AS block_v FROM sig"


def named_blocks(g):
    """Each pair with the smallest pair of its block."""
    b = components.biconnected(g)
    first = b.groupBy("block").agg(F.min(F.struct("u", "v")).alias("f"))
    return b.join(first, "block").select("u", "v", F.col("f.u").alias("block_u"), F.col("f.v").alias("block_v"))


on_both("blocks", named_blocks, sql_blocks(6), sql_blocks(14))
_BRIDGES = ", far AS (SELECT p.u AS bu, p.w AS bw, p.u AS id FROM p UNION SELECT f.bu, f.bw, nb.dst FROM far f JOIN nb ON nb.src = f.id WHERE NOT (nb.src = f.bu AND nb.dst = f.bw) AND NOT (nb.src = f.bw AND nb.dst = f.bu)) SELECT u, w AS v FROM p WHERE NOT EXISTS (SELECT 1 FROM far f WHERE f.bu = u AND f.bw = w AND f.id = w)"
on_both("bridges", lambda g: components.bridges(components.biconnected(g)), _BRIDGES, _BRIDGES)
_CUTS = """, st AS (SELECT src AS cut, min(dst) AS id FROM nb GROUP BY 1), far AS (SELECT cut, id FROM st UNION SELECT f.cut, nb.dst FROM far f JOIN nb ON nb.src = f.id WHERE nb.dst <> f.cut)
 SELECT DISTINCT nb.src AS id FROM nb WHERE NOT EXISTS (SELECT 1 FROM far f WHERE f.cut = nb.src AND f.id = nb.dst)"""
on_both("articulation_points", lambda g: components.articulation_points(components.biconnected(g)), _CUTS, _CUTS)
# a pair is in the forest if the pairs before it do not connect its ends
_FOREST = ", w AS (SELECT least(src, dst) AS u, greatest(src, dst) AS w, min(weight) AS weight FROM e GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (ORDER BY weight, u, w) AS r FROM w), kb AS (SELECT u AS src, w AS dst, r FROM k UNION ALL SELECT w, u, r FROM k), far AS (SELECT r, u AS id FROM k UNION SELECT f.r, kb.dst FROM far f JOIN kb ON kb.src = f.id AND kb.r < f.r) SELECT u, w AS v, weight FROM k WHERE NOT EXISTS (SELECT 1 FROM far f WHERE f.r = k.r AND f.id = k.w)"
on_both("spanning_forest", trees.minimum_spanning_forest, _FOREST, _FOREST)
_TREE = " SELECT (SELECT count(DISTINCT component) FROM comp) = 1 AND mu = n - 1 AS is_tree FROM one"
on_both("is_tree", trees.is_tree, undirected_components(6) + _TREE, undirected_components() + _TREE)


@register("max_flow")
def _(spark, sf):
    g = tables.trade_graph(spark, sf).saved()
    a, b = g.vertices.agg(F.min("id"), F.max("id")).first()
    return flow.max_flow(g, a, b)[1]


_CUT = """, t AS (SELECT min(id) AS a, max(id) AS b FROM v), side AS (SELECT a AS x, a AS y FROM t UNION SELECT a, id FROM v, t WHERE id <> b UNION SELECT b, b FROM t UNION SELECT b, id FROM v, t WHERE id <> a),
 cut AS (SELECT x, y, sum(weight) AS c FROM side, t, e WHERE (x = a AND src IN (x, y) AND dst NOT IN (x, y)) OR (x = b AND dst IN (x, y) AND src NOT IN (x, y)) GROUP BY 1, 2), best AS (SELECT min(c) AS value FROM cut)"""


def ends(g):
    return g.vertices.agg(F.min("id"), F.max("id")).first()


# Every cut that parts the source alone, the sink alone, or one more vertex with either; the least of them is the value where no wider cut is smaller.
@register("max_flow_value", W + TRADE + SHAPE + _CUT + " SELECT value FROM best")
def _(spark, sf):
    g = tables.trade_graph(spark, sf).saved()
    return spark.createDataFrame([(float(flow.max_flow(g, *ends(g))[0]),)], "value double")


@register("min_cut")
def _(spark, sf):
    g = tables.trade_graph(spark, sf).saved()
    return flow.min_cut(g, *ends(g))[1]


@register("flow_balance", W + EDGES + SHAPE + _CUT + " SELECT id, round(CASE id WHEN a THEN -value WHEN b THEN value ELSE 0.0 END, 6) AS balance, CAST(0 AS BIGINT) AS overfull FROM v, t, best")
def _(spark, sf):
    """Of a maximum flow over all pairs: what comes in less what goes out, and edges with more flow than weight, at each vertex."""
    g = whole(spark, sf).saved()
    used = flow.max_flow(g, *ends(g))[1].join(g.edges, ["src", "dst"])
    over = (F.col("flow") > F.col("weight") + 1e-9).cast("long")
    per = used.select(F.col("src").alias("id"), (-F.col("flow")).alias("x"), over.alias("o")).union(used.select("dst", "flow", F.lit(0).cast("long"))).groupBy("id").agg(F.sum("x").alias("x"), F.sum("o").alias("o"))
    zero = F.lit(0).cast("long")
    return g.vertices.select("id").join(per, "id", "left").select("id", (F.round(F.coalesce("x", F.lit(0.0)), 6) + 0.0).alias("balance"), F.coalesce("o", zero).alias("overfull"))


@register("cut_capacity", W + EDGES + SHAPE + _CUT + " SELECT value, value AS across FROM best")
def _(spark, sf):
    """Of a minimum cut over all pairs: its value, and the weight of the edges from the source's side to the other."""
    g = whole(spark, sf).saved()
    value, side = flow.min_cut(g, *ends(g))
    a, b = side.select(F.col("id").alias("src"), F.col("source_side").alias("sa")), side.select(F.col("id").alias("dst"), F.col("source_side").alias("sb"))
    return g.edges.join(a, "src").join(b, "dst").where("sa AND NOT sb").agg(F.lit(float(value)).alias("value"), F.sum("weight").alias("across"))


# ---------------------------------------------------------------- centralities


def sql_pagerank(n: int, share: str = "1.0 / o.k", outs: str = "count(*)") -> str:
    out = f", o AS (SELECT src, {outs} AS k FROM e GROUP BY 1), r0 AS MATERIALIZED (SELECT id, 1.0 / n AS value FROM v, one)"
    for i in range(n):
        out += f", r{i + 1} AS MATERIALIZED (SELECT v.id, 0.15 / n + 0.85 * (coalesce(g.s, 0) + (SELECT coalesce(sum(value), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM o)) / n) AS value FROM one, v LEFT JOIN (SELECT e.dst AS id, sum(r.value * {share}) AS s FROM e JOIN o ON o.src = e.src JOIN r{i} r ON r.id = e.src GROUP BY 1) g USING (id))"
    return out


_PR = W + EDGES + SHAPE + sql_pagerank(15)
register("pagerank", _PR + " SELECT id, round(value, 9) AS value FROM r15")(lambda spark, sf: centrality.pagerank(whole(spark, sf), max_iter=15, tol=0).select("id", F.round("value", 9).alias("value")))
register("pagerank_dangling", W + ACYCLIC + SHAPE + sql_pagerank(15) + " SELECT id, round(value, 9) AS value FROM r15")(lambda spark, sf: centrality.pagerank(tables.acyclic_graph(spark, sf), max_iter=15, tol=0).select("id", F.round("value", 9).alias("value")))
register("pagerank_weighted", W + EDGES + SHAPE + sql_pagerank(15, "e.weight / o.k", "sum(weight)") + " SELECT id, round(value, 9) AS value FROM r15")(lambda spark, sf: centrality.pagerank(whole(spark, sf), max_iter=15, tol=0, weighted=True).select("id", F.round("value", 9).alias("value")))
register("top_pagerank", _PR + " SELECT id, round(value, 9) AS value FROM r15 ORDER BY r15.value DESC, id LIMIT 20")(lambda spark, sf: report.top_k(centrality.pagerank(whole(spark, sf), max_iter=15, tol=0), 20).select("id", F.round("value", 9).alias("value")))


def sql_eigenvector(n: int) -> str:
    out = ", x0 AS (SELECT id, 1.0 / n AS value FROM v, one)"
    for i in range(n):
        out += f", y{i} AS (SELECT id, coalesce(s, 0) AS raw FROM v LEFT JOIN (SELECT nb.dst AS id, sum(value) AS s FROM nb JOIN x{i} x ON x.id = nb.src GROUP BY 1) USING (id)), x{i + 1} AS (SELECT id, raw / (SELECT sqrt(sum(raw * raw)) FROM y{i}) AS value FROM y{i})"
    return out


register("eigenvector", W + EDGES + SHAPE + sql_eigenvector(10) + " SELECT id, round(value, 9) AS value FROM x10")(lambda spark, sf: centrality.eigenvector_centrality(whole(spark, sf), max_iter=10, tol=0).select("id", F.round("value", 9).alias("value")))


def sql_katz(n: int, alpha: float) -> str:
    out = ", k0 AS (SELECT id, 0.0::DOUBLE AS value FROM v)"
    for i in range(n):
        out += f", k{i + 1} AS (SELECT id, 1 + {alpha} * coalesce(s, 0) AS value FROM v LEFT JOIN (SELECT e.dst AS id, sum(value) AS s FROM e JOIN k{i} k ON k.id = e.src GROUP BY 1) USING (id))"
    return out


register("katz", W + EDGES + SHAPE + sql_katz(10, 0.01) + " SELECT id, round(value, 6) AS value FROM k10")(lambda spark, sf: centrality.katz_centrality(whole(spark, sf), alpha=0.01, max_iter=10, tol=0).select("id", r6("value")))
_CL = ", c AS (SELECT source AS id, sum(dist) AS s, count(*) - 1 AS r FROM lev GROUP BY 1)"
for _kind, (_moves, _value) in {"out": ("e", "r * 1.0 / s"), "out_wf": ("e", "r * 1.0 / s * r / (n - 1)"), "und_wf": ("nb", "r * 1.0 / s * r / (n - 1)")}.items():
    register(f"closeness_{_kind}", W + ACYCLIC + SHAPE + sql_levels(_moves, "SELECT id FROM v", 6) + _CL + f" SELECT id, round(CASE WHEN s > 0 THEN {_value} ELSE 0 END, 6) AS value FROM c, one")(lambda spark, sf, k=_kind: centrality.closeness_centrality(tables.acyclic_graph(spark, sf), k).select("id", r6("value")))
register("eccentricity", W + EDGES + SHAPE + sql_levels("nb", "SELECT id FROM v", 5) + " SELECT source AS id, CAST(max(dist) AS DOUBLE) AS value FROM lev GROUP BY 1")(lambda spark, sf: structure.eccentricity(whole(spark, sf)))
register("diameter", W + EDGES + SHAPE + sql_levels("nb", "SELECT id FROM v", 5) + " SELECT max(e) AS diameter, min(e) AS radius FROM (SELECT CAST(max(dist) AS DOUBLE) AS e FROM lev GROUP BY source)")(lambda spark, sf: structure.diameter_and_radius(whole(spark, sf)))


def sql_betweenness(depth: int) -> str:
    """sigma forward, then delta backward, level by level."""
    out = sql_levels("e", "SELECT id FROM v", depth) + ", g0 AS (SELECT source, id, 1.0::DOUBLE AS sigma FROM lev WHERE dist = 0)"
    for d in range(1, depth + 1):
        out += f", g{d} AS (SELECT l.source, l.id, sum(g.sigma) AS sigma FROM lev l JOIN e ON e.dst = l.id JOIN g{d - 1} g ON g.source = l.source AND g.id = e.src WHERE l.dist = {d} GROUP BY 1, 2)"
    out += f", b{depth} AS (SELECT source, id, sigma, 0.0::DOUBLE AS delta FROM g{depth})"
    for d in range(depth - 1, -1, -1):
        out += f", b{d} AS (SELECT g.source, g.id, g.sigma, coalesce(sum(g.sigma / b.sigma * (1 + b.delta)), 0) AS delta FROM g{d} g LEFT JOIN e ON e.src = g.id LEFT JOIN b{d + 1} b ON b.source = g.source AND b.id = e.dst GROUP BY 1, 2, 3)"
    return out + ", bt AS (SELECT id, sum(delta) AS d FROM (" + " UNION ALL ".join(f"SELECT * FROM b{d}" for d in range(1, depth + 1)) + ") GROUP BY 1)"


register("betweenness", W + EDGES + SHAPE + sql_betweenness(4) + " SELECT id, round(coalesce(d, 0) / ((n - 1) * (n - 2)), 9) AS value FROM v LEFT JOIN bt USING (id), one")(lambda spark, sf: centrality.betweenness_centrality(whole(spark, sf)).select("id", F.round("value", 9).alias("value")))
def _edge_shares(depth: int) -> str:
    """Shares of shortest paths over undirected pairs, level by level."""
    out = sql_levels("nb", "SELECT id FROM v", depth).replace(f", lev AS (", ", lev AS MATERIALIZED (") + ", g0 AS MATERIALIZED (SELECT source, id, 1.0::DOUBLE AS sigma FROM lev WHERE dist = 0)"
    for d in range(1, depth + 1):
        out += f", g{d} AS MATERIALIZED (SELECT l.source, l.id, sum(g.sigma) AS sigma FROM lev l JOIN nb ON nb.dst = l.id JOIN g{d - 1} g ON g.source = l.source AND g.id = nb.src WHERE l.dist = {d} GROUP BY 1, 2)"
    out += f", b{depth} AS MATERIALIZED (SELECT source, id, sigma, 0.0::DOUBLE AS delta FROM g{depth})"
    for d in range(depth - 1, -1, -1):
        out += f", s{d} AS MATERIALIZED (SELECT g.source, g.id, b.id AS dst, g.sigma / b.sigma * (1 + b.delta) AS share FROM g{d} g JOIN nb ON nb.src = g.id JOIN b{d + 1} b ON b.source = g.source AND b.id = nb.dst)"
        out += f", b{d} AS MATERIALIZED (SELECT g.source, g.id, g.sigma, coalesce(x.delta, 0) AS delta FROM g{d} g LEFT JOIN (SELECT source, id, sum(share) AS delta FROM s{d} GROUP BY 1, 2) x ON x.source = g.source AND x.id = g.id)"
    return out + " SELECT least(id, dst) AS u, greatest(id, dst) AS v, round(sum(share) / 2, 6) AS value FROM (" + " UNION ALL ".join(f"SELECT * FROM s{d}" for d in range(depth)) + ") GROUP BY 1, 2"


@register("approximate_betweenness", W + EDGES + SHAPE + " SELECT id, true AS within FROM v")
def _(spark, sf):
    """Whether the sampled value of each vertex is as close to the exact one as it says."""
    g = whole(spark, sf).saved()
    exact = centrality.betweenness_centrality(g).withColumnRenamed("value", "exact")
    return centrality.sampled_betweenness(g, 0.05).join(exact, "id").select("id", (F.abs(F.col("value") - F.col("exact")) <= F.col("epsilon")).alias("within"))


on_both("edge_betweenness", lambda g: centrality.edge_betweenness(g).select("u", "v", r6("value")), _edge_shares(4), _edge_shares(14))
on_both("label_propagation", communities.label_propagation)


def sql_colors(rounds: int) -> str:
    """Colour refinement with lists of neighbours' colours in full."""
    out = ", c0 AS MATERIALIZED (SELECT id, dense_rank() OVER (ORDER BY in_degree, out_degree) AS c FROM deg)"
    for i in range(rounds):
        near = lambda at, of: f"SELECT {at} AS id, list_sort(list(c)) AS l FROM e JOIN c{i} ON c{i}.id = {of} GROUP BY 1"  # noqa: B023, E731
        out += f", c{i + 1} AS MATERIALIZED (SELECT c{i}.id, dense_rank() OVER (ORDER BY c, o.l, n.l) AS c FROM c{i} LEFT JOIN ({near('src', 'dst')}) o ON o.id = c{i}.id LEFT JOIN ({near('dst', 'src')}) n ON n.id = c{i}.id)"
    return out + f" SELECT size, count(*) AS classes FROM (SELECT count(*) AS size FROM c{rounds} GROUP BY c) GROUP BY 1"


for _n in (0, 1, 3):
    on_both(f"color_classes_{_n}", lambda g, n=_n: communities.color_refinement(g, n).groupBy("c").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("classes")), sql_colors(_n), sql_colors(_n))
on_both("approximate_reach", lambda g: centrality.approximate_reach(g, 4))
register("full_analysis")(lambda spark, sf: report.full_analysis(whole(spark, sf), "all"))
register("frequent_full_analysis")(lambda spark, sf: report.full_analysis(tables.frequent_graph(spark, sf), "frequent"))


@register("girvan_newman", None)
def _(spark, sf):
    g = tables.frequent_graph(spark, sf)
    return communities.girvan_newman(g, components.connected_components(g).agg(F.count_distinct("component")).first()[0] + 1)


@register("girvan_newman_all", None)
def _(spark, sf):
    return communities.girvan_newman(whole(spark, sf), 2)


@register("compare_graphs", None)
def _(spark, sf):
    a, b = tables.all_pairs_graph(spark, sf), tables.frequent_graph(spark, sf)
    rows = [("all", "all", communities.wl_compare(a, a)), ("all", "frequent", communities.wl_compare(a, b))]
    return spark.createDataFrame(rows, "a string, b string, result string")


# ---------------------------------------------------------------- streams


def _event_stream(spark, sf):
    """The events table as a file stream: user → user of the session key, per event type."""
    schema = tables.read(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    kind = F.coalesce(*[F.when(F.col("event_type") == a, act.normalize_type(F.lit(b))) for a, b in tables.EVENT_TYPES.items()], F.lit("unknown"))
    key = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("actor"), key.alias("target"), kind.alias("type"), F.col("ts").cast("timestamp").alias("created_at"))


def _drained(spark, df, mode, name):
    """All that is there now, through the streaming engine: the last batch's table, or in append mode those of all batches."""
    from .plans.loop import checkpoint_dir

    place = f"{checkpoint_dir(spark)}/stream-{name}-{__import__('uuid').uuid4().hex}"

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{place}/out/{number if mode == 'append' else 0}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{place}/out/*")


_ST = "WITH s AS (SELECT event_id, user_id AS actor, CAST(json_extract_string(props, '$.k') AS BIGINT) AS target, event_type, ts FROM events)"


@register("stream_edge_weights", _ST + " SELECT actor AS src, target AS dst, CAST(sum(CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 5 ELSE 1 END) AS DOUBLE) AS weight FROM s WHERE actor <> target GROUP BY 1, 2")
def _(spark, sf):
    return _drained(spark, stream.stream_edge_weights(_event_stream(spark, sf)), "complete", "weights")


@register("stream_window_counts", _ST + " SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, CASE event_type WHEN 'click' THEN 'COMMENT_ON_ISSUE_OR_PR' WHEN 'view' THEN 'ISSUE_CLOSED_BY_OTHER' WHEN 'signup' THEN 'PR_REVIEW_OR_APPROVAL' WHEN 'purchase' THEN 'PR_MERGE' ELSE 'unknown' END AS type, count(*) AS n FROM s GROUP BY 1, 2")
def _(spark, sf):
    return _drained(spark, stream.stream_window_counts(_event_stream(spark, sf)), "complete", "windows").select(F.col("start").cast("timestamp_ntz").alias("start"), "type", "n")


@register("stream_dedupe", _ST + " SELECT event_id AS id, actor, target FROM s")
def _(spark, sf):
    e = _event_stream(spark, sf)
    return _drained(spark, stream.stream_dedupe(e.union(e), delay="10000 days"), "append", "dedupe").select("id", "actor", "target")
