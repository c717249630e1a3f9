"""Sources: interaction CSV, raw and refined JSON, edge records, GEXF, edge lists, sample data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.activity import COMMENT, normalize_type
from ..graph import Graph, graph

_USER = "STRUCT<login: STRING>"
#: Schemas of the raw records, by kind.
RAW_SCHEMAS = {
    "issue_comments": f"id BIGINT, node_id STRING, url STRING, html_url STRING, issue_url STRING, user {_USER}, created_at STRING, updated_at STRING, body STRING, author_association STRING, issue STRUCT<user: {_USER}>",
    "pr_comments": f"id BIGINT, node_id STRING, url STRING, html_url STRING, pull_request_url STRING, commit_id STRING, original_commit_id STRING, diff_hunk STRING, path STRING, position BIGINT, original_position BIGINT, line BIGINT, original_line BIGINT, start_line BIGINT, original_start_line BIGINT, user {_USER}, created_at STRING, updated_at STRING, body STRING, author_association STRING, _pr_author STRING",
    "closed_issues": f"url STRING, number BIGINT, state STRING, user {_USER}, closed_by {_USER}, pull_request STRUCT<url: STRING>, created_at STRING, closed_at STRING",
    "pr_reviews": f"id BIGINT, user {_USER}, body STRING, state STRING, html_url STRING, pull_request_url STRING, submitted_at STRING, commit_id STRING, author_association STRING, _pr_author STRING, _pr_url STRING",
    "pull_requests": f"id BIGINT, number BIGINT, state STRING, title STRING, body STRING, locked BOOLEAN, user {_USER}, assignee {_USER}, merged BOOLEAN, merged_by {_USER}, merged_at STRING, created_at STRING, updated_at STRING, closed_at STRING, merge_commit_sha STRING, comments BIGINT, review_comments BIGINT, commits BIGINT, additions BIGINT, deletions BIGINT, changed_files BIGINT",
}
#: Schemas of the typed JSON-lines records.
LINE_SCHEMAS = {
    "issue_comments": "issue_number BIGINT, author STRING, body STRING, created_at TIMESTAMP",
    "issue_closures": "issue_number BIGINT, author STRING, closed_by STRING, closed_at TIMESTAMP",
    "pr_comments": "pr_number BIGINT, author STRING, body STRING, created_at TIMESTAMP",
    "pr_reviews": "pr_number BIGINT, author STRING, state STRING, submitted_at TIMESTAMP",
    "pr_approvals": "pr_number BIGINT, author STRING, submitted_at TIMESTAMP",
    "pr_merges": "pr_number BIGINT, merged_by STRING, merged_at TIMESTAMP",
}


def read_interactions_csv(spark: SparkSession, path: str, on_unknown: str = "drop", keep_self: bool = True) -> DataFrame:
    """actor, target, type from CSV with a header in any case and spacing; lines starting with # and blank ends go.

    Unknown types are dropped or, with ``on_unknown="comment"``, count as comments.  A missing required
    column raises ValueError.
    """
    raw = spark.read.csv(path, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = {c.strip().lower().lstrip("﻿"): c for c in raw.columns}
    if missing := {"actor", "target", "type"} - names.keys():
        raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
    rows = raw.select(*[F.trim(F.col(f"`{names[c]}`")).alias(c) for c in ("actor", "target", "type")])
    kind = normalize_type(F.col("type"))
    rows = rows.where("actor <> '' AND target <> ''").withColumn("type", F.coalesce(kind, F.lit(COMMENT)) if on_unknown == "comment" else kind)
    return rows.where("type IS NOT NULL" + ("" if keep_self else " AND actor <> target"))


def read_raw_json(spark: SparkSession, directory: str, kind: str) -> DataFrame:
    """All records of ``<kind>_part_*.json`` array files, with the file name in ``_file``."""
    rows = spark.read.schema(RAW_SCHEMAS[kind]).option("multiLine", True).json(f"{directory}/{kind}_part_*.json")
    return rows.withColumn("_file", F.input_file_name())


def read_raw_jsonl(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Newline-delimited typed records."""
    return spark.read.schema(LINE_SCHEMAS[kind]).json(path)


def read_refined_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(users(login, id), interactions(source, target, type, weight)) of a refined file; both interaction forms are read."""
    item = "STRUCT<source: STRING, target: STRING, type: STRING, `from`: STRING, `to`: STRING, weight: DOUBLE>"
    schema = f"metadata STRUCT<total_users: BIGINT, total_interactions: BIGINT>, users MAP<STRING, BIGINT>, interactions ARRAY<{item}>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    users = doc.select(F.explode("users").alias("login", "id"))
    i = doc.select(F.explode("interactions").alias("i"))
    return users, i.select(F.coalesce("i.source", "i.from").alias("source"), F.coalesce("i.target", "i.to").alias("target"), "i.type", "i.weight")


#: Lists that may wrap records, and the key pairs tried in order.
WRAPPERS = ["items", "data", "events", "commits", "issues", "prs"]
KEY_PAIRS = [("user", "target"), ("author", "repo"), ("from", "to"), ("source", "target"), ("login", "repo_full_name")]


def read_edge_records(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of records in any JSON file: an array, an object that wraps one, or one record; the first key pair that is not empty counts."""
    keys = sorted({k for p in KEY_PAIRS for k in p})
    record = "STRUCT<" + ", ".join(f"`{k}`: STRING" for k in keys) + ">"
    schema = ", ".join([f"`{k}` STRING" for k in keys] + [f"`{w}` ARRAY<{record}>" for w in WRAPPERS])
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    own = F.struct(*[F.col(f"`{k}`").alias(k) for k in keys])
    wrapped = F.coalesce(*[F.col(w) for w in WRAPPERS], F.array(own))
    rows = doc.select(F.explode(wrapped).alias("r"))
    full = lambda k: F.coalesce(F.col(f"r.`{k}`"), F.lit("")) != ""
    pick = F.coalesce(*[F.when(full(a) & full(b), F.struct(F.col(f"r.`{a}`").alias("src"), F.col(f"r.`{b}`").alias("dst"))) for a, b in KEY_PAIRS])
    return rows.select(pick.alias("p")).where("p IS NOT NULL").select("p.src", "p.dst")


def edge_record_summary(records: DataFrame) -> DataFrame:
    """One row: records, different sources, different targets."""
    return records.agg(F.count("*").alias("records"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


def read_gexf(spark: SparkSession, path: str) -> tuple[Graph, bool]:
    """(graph, directed).  Ids are strings; self-loops and edges with unknown ends are skipped, the last of repeated edges counts; an undirected file gives both directions."""
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes = xml("node", "_id STRING, _label STRING, _weight DOUBLE").select(F.col("_id").alias("id"), F.col("_label").alias("label"), F.col("_weight").alias("weight")).where("id IS NOT NULL")
    kinds = xml("graph", "_defaultedgetype STRING").agg(F.max("_defaultedgetype")).first()
    directed = (kinds[0] or "directed") != "undirected"
    rows = xml("edge", "_id STRING, _source STRING, _target STRING, _weight DOUBLE").select(F.expr("try_cast(_id AS BIGINT)").alias("n"), F.col("_source").alias("src"), F.col("_target").alias("dst"), F.coalesce("_weight", F.lit(1.0)).alias("weight")).where("src <> dst")
    known = nodes.select("id").distinct()
    rows = rows.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    if not directed:
        rows = rows.select("n", "src", "dst", "weight").unionByName(rows.select("n", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    last = rows.groupBy("src", "dst").agg(F.max_by("weight", F.coalesce("n", F.lit(-1))).alias("weight"))
    return graph(last, nodes), directed


def read_edgelist(spark: SparkSession, path: str, sep: str = " ", directed: bool = False) -> Graph:
    """Lines ``u v [w]``; weight 1 where it is missing or no number; lines with fewer than two fields are skipped; undirected adds the mirror edges."""
    f = F.split(F.trim("value"), F.lit("\\s+" if sep == " " else f"\\Q{sep}\\E"))
    rows = spark.read.text(path).select(f.alias("f")).where(F.size("f") >= 2)
    e = rows.select(F.col("f")[0].alias("src"), F.col("f")[1].alias("dst"), F.coalesce(F.expr("try_cast(get(f, 2) AS DOUBLE)"), F.lit(1.0)).alias("weight"))
    return graph(e if directed else e.union(e.select("dst", "src", "weight")))


def sample_interactions(spark: SparkSession, n: int = 120, users: int = 10, seed: int = 42) -> DataFrame:
    """n random interactions less the self pairs, the same under any partitioning: every value is a hash of (seed, row)."""
    pick = lambda salt, k: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(k)).cast("int")
    kinds = F.array(*map(F.lit, ["comment", "issue_commented", "review", "merge"]))
    rows = spark.range(n).select(F.format_string("user%d", pick(1, users)).alias("actor"), F.format_string("user%d", pick(2, users)).alias("target"), normalize_type(F.element_at(kinds, pick(3, 4) + 1)).alias("type"))
    return rows.where("actor <> target")
