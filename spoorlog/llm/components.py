"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorlog.session import staged


def components(links: DataFrame) -> DataFrame:
    """node, comp for every node of ``links`` (a, b): comp is the least node of its component.

    Each round a node takes the least label among itself and its neighbours, then
    the label of that label, so labels cross a long chain in a logarithmic number
    of rounds. Labels are written to the shared folder each round; only the number
    of changes reaches the driver.
    """
    both = staged(
        links.select(F.col("a").alias("here"), F.col("b").alias("there")).union(links.select("b", "a")).filter("here <> there").distinct(), "links")
    labels = staged(both.groupBy("here").agg(F.min("there").alias("there")).select(
        F.col("here").alias("node"), F.least("here", "there").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("there"), "comp"), "there").groupBy("here").agg(F.min("comp").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("here")).select("node", F.least("comp", "near").alias("new"), F.col("comp").alias("old"))
        far = labels.select(F.col("node").alias("of"), F.col("comp").alias("far"))
        nxt = staged(lower.join(far, F.col("new") == F.col("of"), "left").select(
            "node", F.least("new", F.coalesce("far", "new")).alias("comp"), "old"), "labels")
        settled = nxt.filter("comp <> old").isEmpty()
        labels = nxt.select("node", "comp")
        if settled:
            return labels


def with_comp(rows: DataFrame, comp: DataFrame, node: str, name: str) -> DataFrame:
    """Adds the component of a column of nodes; a node without links is its own."""
    side = comp.select(F.col("node").alias(f"of_{name}"), F.col("comp").alias(f"found_{name}"))
    return rows.join(side, F.col(node) == F.col(f"of_{name}"), "left").withColumn(
        name, F.coalesce(f"found_{name}", node)).drop(f"of_{name}", f"found_{name}")


def grown(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components with more links: only links between different components are looked at."""
    ends = with_comp(with_comp(links.select("a", "b"), comp, "a", "ca"), comp, "b", "cb")
    between = staged(ends.filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "links")
    if between.isEmpty():
        return comp
    top = components(between)
    renamed = top.select(F.col("node").alias("before"), F.col("comp").alias("after"))
    moved = comp.join(renamed, F.col("comp") == F.col("before"), "left").select("node", F.coalesce("after", "comp").alias("comp"))
    return staged(moved.union(top.join(comp, "node", "left_anti").select("node", "comp")), "components")
