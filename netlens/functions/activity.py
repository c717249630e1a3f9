"""Projections, filters and scalar functions on raw activity and results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of interaction types, trimmed and lower-cased → canonical type.
TYPE_ALIASES = {
    "comment": "COMMENT_ON_ISSUE_OR_PR",
    "comment_on_issue_or_pr": "COMMENT_ON_ISSUE_OR_PR",
    "issue_commented": "ISSUE_CLOSED_BY_OTHER",
    "issue_closed_by_other": "ISSUE_CLOSED_BY_OTHER",
    "review": "PR_REVIEW_OR_APPROVAL",
    "pr_review_or_approval": "PR_REVIEW_OR_APPROVAL",
    "merge": "PR_MERGE",
    "pr_merge": "PR_MERGE",
}
#: Weight of a canonical type.
TYPE_WEIGHTS = {"COMMENT_ON_ISSUE_OR_PR": 2, "ISSUE_CLOSED_BY_OTHER": 3, "PR_REVIEW_OR_APPROVAL": 4, "PR_MERGE": 5}
COMMENT, CLOSURE, REVIEW, MERGE = TYPE_WEIGHTS
#: Fixed value: a user mention; there is no left boundary, so an address a@b.com mentions b.
MENTION = "@([A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?)"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def normalize_type(c: Column) -> Column:
    """Canonical type of a name, null if it is unknown."""
    return _map(TYPE_ALIASES)[F.lower(F.trim(c))]


def type_weight(c: Column, weights: dict | None = None, default: float = 1.0) -> Column:
    """Weight of a canonical type; unknown ones weigh ``default``."""
    return F.coalesce(_map(weights or TYPE_WEIGHTS)[c].cast("double"), F.lit(float(default)))


def extract_mentions(c: Column) -> Column:
    """Mentioned users in order of first appearance, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(MENTION), F.lit(1)))


def drop_self(df: DataFrame, actor: str = "actor", target: str = "target") -> DataFrame:
    """Rows with two different, non-empty ends."""
    full = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return df.where(full(actor) & full(target) & (F.col(actor) != F.col(target)))


def since(df: DataFrame, as_of: str, years_back: int = 5, column: str = "created_at", calendar: bool = False) -> DataFrame:
    """Rows of the last ``years_back`` years before ``as_of``: of 365 days, or calendar years."""
    end = F.to_timestamp(F.lit(as_of))
    start = end - (F.make_interval(years=F.lit(years_back)) if calendar else F.make_dt_interval(days=F.lit(365 * years_back)))
    return df.where(F.col(column) >= start)


def only_issues(df: DataFrame) -> DataFrame:
    """Issue rows that are not pull requests."""
    return df.where("pull_request IS NULL")


def minmax_scale(df: DataFrame, metric: str, lo: float = 8.0, hi: float = 20.0, name: str = "scaled") -> DataFrame:
    """``metric`` scaled to lo..hi; where all are equal, everything is ``lo``."""
    ends = df.agg(F.min(metric).cast("double").alias("_lo"), F.max(metric).cast("double").alias("_hi"))
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    return df.crossJoin(F.broadcast(ends)).withColumn(name, lo + (F.col(metric) - F.col("_lo")) / span * (hi - lo)).drop("_lo", "_hi")


def color_ramp(df: DataFrame, metric: str, low: tuple = (66, 133, 244), high: tuple = (234, 67, 53), name: str = "color") -> DataFrame:
    """A hex colour between two, by the scaled metric."""
    t = minmax_scale(df, metric, 0.0, 1.0, "_t")
    channel = [F.round(F.lit(a) + F.col("_t") * (b - a)).cast("int") for a, b in zip(low, high)]
    return t.withColumn(name, F.format_string("#%02x%02x%02x", *channel)).drop("_t")


def clamp_edge_width(df: DataFrame, weight: str = "weight", name: str = "width") -> DataFrame:
    """Line width 0.8 * weight, at least 0.5 and at most 4."""
    return df.withColumn(name, F.greatest(F.lit(0.5), F.least(F.lit(4.0), F.col(weight) * 0.8)))


def community_palette(df: DataFrame, ranked: DataFrame, colors: list[str], name: str = "color") -> DataFrame:
    """``df(id, component)`` with a colour by the community's rank (0..n-1 in ``ranked(component, rank)``) modulo the palette."""
    pick = F.element_at(F.array(*map(F.lit, colors)), (F.pmod("rank", F.lit(len(colors))) + 1).cast("int"))
    return df.join(ranked.select("component", "rank"), "component").withColumn(name, pick).drop("rank")


def circular_positions(indexed: DataFrame, n: int) -> DataFrame:
    """x, y on the unit circle for rows with an index 0..n-1."""
    angle = F.col("index") * (2 * math.pi) / n
    return indexed.withColumn("x", F.cos(angle)).withColumn("y", F.sin(angle))


# ---------------------------------------------------------------- raw records

#: Columns of a projected record by kind, output name → path in the record.
PROJECTIONS: dict[str, dict[str, str]] = {
    "issue_comments": {"id": "id", "issue_url": "issue_url", "author": "user.login", "created_at": "created_at", "updated_at": "updated_at", "body": "body", "author_association": "author_association"},
    "closed_issues": {"number": "number", "url": "url", "author": "user.login", "closed_by": "closed_by.login", "created_at": "created_at", "closed_at": "closed_at"},
    "pr_comments": {"id": "id", "pull_request_url": "pull_request_url", "author": "user.login", "created_at": "created_at", "body": "body", "path": "path", "commit_id": "commit_id"},
    "pr_reviews": {"id": "id", "pull_request_url": "pull_request_url", "author": "user.login", "state": "state", "submitted_at": "submitted_at", "body": "body"},
    "pr_openings": {"number": "number", "author": "user.login", "title": "title", "state": "state", "created_at": "created_at"},
    "pr_merges": {"number": "number", "author": "user.login", "merged_by": "merged_by.login", "merged_at": "merged_at", "merge_commit_sha": "merge_commit_sha"},
    "approvals": {"id": "id", "pull_request_url": "pull_request_url", "author": "user.login", "submitted_at": "submitted_at"},
}
_KEEP = {"pr_merges": "merged_at IS NOT NULL", "approvals": "state = 'APPROVED'"}
_TIMES = {"created_at", "updated_at", "closed_at", "merged_at", "submitted_at"}


def project_raw(df: DataFrame, kind: str) -> DataFrame:
    """A nested record as flat columns; times become timestamps; merges need merged_at, approvals the state APPROVED."""
    rows = df.where(_KEEP[kind]) if kind in _KEEP else df
    return rows.select(*[(F.to_timestamp(p) if n in _TIMES else F.col(p)).alias(n) for n, p in PROJECTIONS[kind].items()])
