"""Connected components of a link table, by hooking to the least neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Workspace


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the least node it is connected with.

    Each round every node hooks to its least neighbour if that is smaller,
    hooks are followed once more, and links are rewritten to the hooked nodes,
    those within one node dropping out. A star vanishes in one round; links
    shrink at least by half for any other shape. Minima are combined before
    they are shuffled, and joins meet a hub on one side only, so a hub may be
    split. Each round is written to the shared folder and the round before deleted.
    """
    own = Workspace(links.sparkSession)
    links = own.write(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = own.write(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("label")), "labels")
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        first = own.write(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up")).select(F.col("a").alias("at"), "up"), "hooks")
        again = first.select(F.col("at").alias("at2"), F.col("up").alias("up2"))
        hooks = own.write(first.join(again, F.col("up") == F.col("at2"), "left").select("at", F.coalesce("up2", "up").alias("up")), "hooks")
        now = own.write(labels.join(hooks, F.col("label") == F.col("at"), "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        moved = links.join(hooks.select(F.col("at").alias("x"), F.col("up").alias("a2")), F.col("a") == F.col("x"), "left").select(F.coalesce("a2", "a").alias("a"), "b")
        moved = moved.join(hooks.select(F.col("at").alias("x"), F.col("up").alias("b2")), F.col("b") == F.col("x"), "left").select("a", F.coalesce("b2", "b").alias("b"))
        left = own.write(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        own.drop(first, hooks, labels, links)
        labels, links = now, left
    own.drop(links)
    return labels
