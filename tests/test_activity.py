"""Sources, sinks, raw-record functions and streams."""

import json

import pytest
from pyspark.sql import functions as F

from netlens import graph as G
from netlens.functions import activity as act
from netlens.operators import build, interactions
from netlens.sources import readers, writers
from netlens.streaming import stream


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Actor ,TARGET,Type\nalice,bob,comment\n# note\nbob,charlie, MERGE \nx,,comment\nann,ann,review\nann,bob,dance\n")
    df = readers.read_interactions_csv(spark, str(tmp_path / "a.csv"))
    assert {tuple(r) for r in df.collect()} == {("alice", "bob", act.COMMENT), ("bob", "charlie", act.MERGE), ("ann", "ann", act.REVIEW)}
    assert readers.read_interactions_csv(spark, str(tmp_path / "a.csv"), "comment", keep_self=False).count() == 3
    g = build.weighted_graph(df)
    assert {tuple(r) for r in g.edges.collect()} == {("alice", "bob", 2.0), ("bob", "charlie", 5.0)} and g.vertices.count() == 4
    graphs = build.build_all_graphs(df)
    assert {k: v.edges.count() for k, v in graphs.items()} == {"graph1": 1, "graph2": 0, "graph3": 1, "integrated": 2}
    assert graphs["graph3"].vertices.count() == 3 and graphs["graph2"].vertices.count() == 0
    (tmp_path / "b.csv").write_text("actor,kind\na,b\n")
    with pytest.raises(ValueError):
        readers.read_interactions_csv(spark, str(tmp_path / "b.csv"))
    writers.write_interactions_csv(spark.createDataFrame([("u", ["v", "u", "v"], ["w"], "comment")], "author string, mentions array<string>, assignees array<string>, type string"), str(tmp_path / "out"))
    assert {r.target for r in readers.read_interactions_csv(spark, str(tmp_path / "out")).collect()} == {"v", "w"}


def test_mentions_and_types(spark):
    rows = [("Thanks @user1 and @user2 for the help! cc @dev-team",), ("a@b.com @b",), ("none",), (None,)]
    got = [r.m for r in spark.createDataFrame(rows, "t string").select(act.extract_mentions(F.col("t")).alias("m")).collect()]
    assert got == [["user1", "user2", "dev-team"], ["b"], [], []]
    kinds = spark.createDataFrame([(" Comment ",), ("PR_MERGE",), ("x",), (None,)], "t string").select(act.normalize_type(F.col("t"))).collect()
    assert [r[0] for r in kinds] == [act.COMMENT, act.MERGE, None, None]
    rows = spark.createDataFrame([("a", "2024-01-02"), ("b", "2019-01-01")], "k string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    assert [r.k for r in act.since(rows, "2024-06-01").collect()] == ["a"] == [r.k for r in act.since(rows, "2024-06-01", 5, calendar=True).collect()]


def user(x):
    return None if x is None else {"login": x}


@pytest.fixture()
def raw(spark, tmp_path):
    put = lambda name, rows: (tmp_path / name).write_text(json.dumps(rows))
    put("issue_comments_part_0.json", [{"id": 1, "user": user("ann"), "issue_url": "i1", "body": "hi @cat"}, {"id": 2, "user": user("bob"), "issue_url": "i9"}])
    put("issue_comments_part_1.json", [{"id": 3, "user": user("bob"), "issue_url": "i2", "issue": {"user": user("eve")}}])
    put("closed_issues_part_0.json", [{"url": "i1", "number": 1, "state": "closed", "user": user("bob"), "closed_by": user("ann"), "closed_at": "2024-01-01T00:00:00Z"}, {"url": "i2", "number": 2, "state": "open", "user": user("bob"), "closed_by": None}, {"url": "p3", "number": 3, "pull_request": {"url": "x"}, "user": user("bob"), "closed_by": user("bob")}])
    put("pr_comments_part_0.json", [{"id": 4, "user": user("ann"), "pull_request_url": "p1"}, {"id": 5, "user": user("ann"), "_pr_author": "dan"}])
    put("pr_reviews_part_0.json", [{"id": 6, "user": user("eve"), "state": "APPROVED", "_pr_author": "bob", "_pr_url": "p1", "submitted_at": "2024-01-01T00:00:00Z"}])
    put("pull_requests_part_0.json", [{"id": 7, "number": 9, "user": user("bob"), "merged_by": user("eve"), "merged_at": "2024-01-01T00:00:00Z"}, {"id": 8, "number": 10, "user": user("bob")}])
    return {k: readers.read_raw_json(spark, str(tmp_path), k) for k in readers.RAW_SCHEMAS}


def test_refine(spark, raw, tmp_path):
    users, inter, counts = interactions.refine(raw["issue_comments"], raw["pr_comments"], raw["closed_issues"], raw["pr_reviews"])
    want = {("ann", "bob", act.COMMENT), ("bob", "eve", act.COMMENT), ("ann", "dan", act.COMMENT), ("ann", "bob", act.CLOSURE), ("eve", "bob", act.REVIEW)}
    assert {tuple(r) for r in inter.collect()} == want and inter.count() == 6
    assert {r.login: r.id for r in users.collect()} == {"ann": 0, "bob": 1, "dan": 2, "eve": 3}
    assert [tuple(r) for r in interactions.merge_interactions(raw["pull_requests"]).collect()] == [("eve", "bob", act.MERGE)]
    assert [tuple(r) for r in interactions.mention_interactions(raw["issue_comments"]).collect()] == [("ann", "cat", act.COMMENT)]
    authors = interactions.issue_author_map(raw["closed_issues"])
    assert interactions.unmatched(raw["issue_comments"], authors, F.col("issue.user.login"), "issue_url").count() == 1
    assert [tuple(r) for r in interactions.closure_weights(raw["closed_issues"]).collect()] == [("ann", "bob", 3)]
    stats = interactions.collection_stats(raw["closed_issues"], raw["pull_requests"], raw["issue_comments"], raw["pr_reviews"], inter).first()
    assert tuple(stats) == (2, 2, 3, 1, 4, 4)
    assert act.project_raw(raw["pr_reviews"], "approvals").count() == 1 and act.project_raw(raw["pull_requests"], "pr_merges").first().merged_by == "eve"
    assert act.only_issues(raw["closed_issues"]).count() == 2
    writers.write_refined_json(inter, users, str(tmp_path / "refined"))
    assert spark.read.json(str(tmp_path / "refined/metadata")).first().total_users == 4
    (tmp_path / "r.json").write_text(json.dumps({"metadata": {}, "users": {"a": 0, "b": 1}, "interactions": [{"from": "a", "to": "b", "weight": 3}, {"source": "b", "target": "a", "type": "merge"}]}))
    u, i = readers.read_refined_json(spark, str(tmp_path / "r.json"))
    assert u.count() == 2 and {(r.source, r.target) for r in i.collect()} == {("a", "b"), ("b", "a")}


def test_edge_records_and_lists(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"items": [{"user": "a", "target": "b"}, {"author": "", "repo": "x", "from": "c", "to": "d"}, {"login": "e"}]}))
    assert {tuple(r) for r in readers.read_edge_records(spark, str(tmp_path / "e.json")).collect()} == {("a", "b"), ("c", "d")}
    (tmp_path / "l.txt").write_text("a b 2.5\nb c\nlone\nc a x\n")
    g = readers.read_edgelist(spark, str(tmp_path / "l.txt"))
    assert g.edges.count() == 6 and g.edges.where("src = 'b' AND dst = 'a'").first().weight == 2.5
    writers.write_edgelist(g, str(tmp_path / "l2"))
    assert sorted(readers.read_edgelist(spark, str(tmp_path / "l2")).edges.collect()) == sorted(g.edges.collect())
    a, b = (readers.sample_interactions(spark, 120, 10, 42) for _ in range(2))
    assert a.collect() == b.collect() and 90 < a.count() < 120


@pytest.mark.parametrize("directed", [True, False])
def test_gexf_round_trip(spark, tmp_path, directed):
    e = spark.createDataFrame([("a", "b", 1.5), ("b", "a", 1.5), ("a", "c&<", 2.0), ("c&<", "a", 2.0)], "src string, dst string, weight double")
    g = G.graph(e, spark.createDataFrame([("z", 'lone "one"', 3.0)], "id string, label string, weight double"))
    writers.write_gexf(g, str(tmp_path / "g.gexf"), directed, vertex_weight=True)
    parts = sorted((tmp_path / "g.gexf").glob("part-*"))
    (tmp_path / "one.gexf").write_text("".join(p.read_text() for p in parts))
    back, was = readers.read_gexf(spark, str(tmp_path / "one.gexf"))
    assert was is directed and sorted(back.edges.collect()) == sorted(g.edges.collect())
    assert {tuple(r) for r in back.vertices.collect()} == {tuple(r) for r in g.vertices.collect()}


def test_streams_equal_batches(spark, tmp_path):
    rows = [{"id": i % 40, "actor": f"u{i % 5}", "target": f"u{i % 3}", "type": act.COMMENT, "created_at": f"2024-01-{1 + i % 9:02d}T00:00:00Z"} for i in range(60)]
    for k in range(3):
        (tmp_path / f"x_part_{k}.json").write_text(json.dumps(rows[20 * k : 20 * k + 20]))
    schema = "id long, actor string, target string, type string, created_at timestamp"
    source = stream.stream_raw(spark, str(tmp_path), "x", schema, files_per_trigger=1)
    out = str(tmp_path / "weights")
    q = stream.stream_edge_weights(source).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).foreachBatch(stream.merge_weights(spark, out)).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path / "x_part_*.json"))
    want = {tuple(r) for r in build.weighted_graph(batch).edges.collect()}
    assert {tuple(r) for r in stream.merged_weights(spark, out).collect()} == want
    once = stream.stream_dedupe(source, delay="1000 days").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == 40
    win = stream.stream_window_counts(source, delay="1000 days").writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    win.awaitTermination()
    assert spark.table("win").agg(F.sum("n")).first()[0] == 60
