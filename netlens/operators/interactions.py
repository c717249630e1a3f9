"""Raw records to interactions: joins of comments, closures, reviews and merges with their authors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.activity import CLOSURE, COMMENT, MERGE, REVIEW, extract_mentions
from ..plans.loop import dense_index


def issue_author_map(closed_issues: DataFrame) -> DataFrame:
    """url → author of issues; of repeated urls the record last closed counts."""
    return closed_issues.where("url IS NOT NULL AND user.login IS NOT NULL").groupBy("url").agg(F.max_by("user.login", F.struct("closed_at", "number")).alias("author"))


def pr_author_map(reviews: DataFrame) -> DataFrame:
    """url → author of pull requests, from reviews."""
    return reviews.where("_pr_url IS NOT NULL AND _pr_author IS NOT NULL").groupBy(F.col("_pr_url").alias("url")).agg(F.max_by("_pr_author", F.struct("submitted_at", "id")).alias("author"))


def _edges(rows: DataFrame, source, target, kind: str) -> DataFrame:
    """(source, target, type); rows without two different ends go."""
    out = rows.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"))
    return out.where("source <> '' AND target <> '' AND source <> target")


def _with_author(comments: DataFrame, authors: DataFrame, own, url: str) -> DataFrame:
    return comments.join(authors.select(F.col("url").alias("_u"), F.col("author").alias("_author")), F.col(url) == F.col("_u"), "left").withColumn("_target", F.coalesce(own, "_author"))


def issue_comment_interactions(comments: DataFrame, authors: DataFrame) -> DataFrame:
    """commenter → issue author: the record's own, else looked up by issue_url."""
    return _edges(_with_author(comments, authors, F.col("issue.user.login"), "issue_url"), F.col("user.login"), F.col("_target"), COMMENT)


def pr_comment_interactions(comments: DataFrame, authors: DataFrame) -> DataFrame:
    """commenter → pull request author: the record's own, else looked up by pull_request_url."""
    return _edges(_with_author(comments, authors, F.col("_pr_author"), "pull_request_url"), F.col("user.login"), F.col("_target"), COMMENT)


def unmatched(comments: DataFrame, authors: DataFrame, own, url: str) -> DataFrame:
    """Comments whose author is neither in the record nor in the map."""
    return comments.where(own.isNull()).join(authors.select(F.col("url").alias("_u")), F.col(url) == F.col("_u"), "left_anti")


def closure_interactions(closed_issues: DataFrame, only_closed: bool = False) -> DataFrame:
    """closer → issue author, by someone else; deleted users are skipped."""
    rows = closed_issues.where("state = 'closed'") if only_closed else closed_issues
    return _edges(rows, F.col("closed_by.login"), F.col("user.login"), CLOSURE)


def review_interactions(reviews: DataFrame) -> DataFrame:
    """reviewer → pull request author."""
    return _edges(reviews, F.col("user.login"), F.col("_pr_author"), REVIEW)


def merge_interactions(pulls: DataFrame) -> DataFrame:
    """merger → pull request author of merged pull requests."""
    return _edges(pulls.where("merged_at IS NOT NULL"), F.col("merged_by.login"), F.col("user.login"), MERGE)


def mention_interactions(comments: DataFrame, author: str = "user.login", body: str = "body") -> DataFrame:
    """commenter → everyone mentioned in the body, as comments."""
    rows = comments.select(F.col(author).alias("_a"), F.explode(extract_mentions(F.col(body))).alias("_m"))
    return _edges(rows, F.col("_a"), F.col("_m"), COMMENT)


def expand_targets(df: DataFrame) -> DataFrame:
    """(actor, target, type) of rows (author, mentions[, assignees], type): one per different target."""
    names = [F.coalesce(c, F.array().cast("array<string>")) for c in ("mentions", "assignees") if c in df.columns]
    return df.select(F.col("author").alias("actor"), F.explode(F.array_distinct(F.concat(*names))).alias("target"), "type")


def refine(issue_comments: DataFrame, pr_comments: DataFrame, closed_issues: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users(login, id), interactions, counts(type, n)) of the four raw tables; ids follow the logins' order."""
    all_ = (
        issue_comment_interactions(issue_comments, issue_author_map(closed_issues))
        .unionByName(pr_comment_interactions(pr_comments, pr_author_map(reviews)))
        .unionByName(closure_interactions(closed_issues))
        .unionByName(review_interactions(reviews))
    )
    logins = all_.select(F.col("source").alias("login")).union(all_.select("target")).distinct()
    return dense_index(logins, ["login"], "id"), all_, all_.groupBy("type").agg(F.count("*").alias("n"))


def closure_weights(closed_issues: DataFrame, weight: int = 3) -> DataFrame:
    """(from, to, weight): closer → opener, so much per closure."""
    e = closure_interactions(closed_issues)
    return e.groupBy(F.col("source").alias("from"), F.col("target").alias("to")).agg(F.sum(F.lit(weight)).alias("weight"))


def collection_stats(closed_issues: DataFrame, pulls: DataFrame, comments: DataFrame, reviews: DataFrame, interactions: DataFrame) -> DataFrame:
    """One row of counters: issues, pulls, comments, reviews, users, edges."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    users = interactions.select("source").union(interactions.select("target")).distinct()
    edges = interactions.select("source", "target").distinct()
    out = one(closed_issues.where("pull_request IS NULL"), "issues")
    for df, name in ((pulls, "pulls"), (comments, "comments"), (reviews, "reviews"), (users, "users"), (edges, "edges")):
        out = out.crossJoin(one(df, name))
    return out
