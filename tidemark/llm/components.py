"""Connected components as joins and grouped minima."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """Edges (a, b) → (id, component): the smallest id reachable, for every id an edge names.

    Each round every vertex points to its smallest neighbour, pointers are doubled until all end at a root, and the edges
    are rewritten between roots; edges inside a root disappear. Rounds are logarithmic, every stage is a stored table, and
    hubs are only ever one side of a join of two stored tables, which adaptive execution can split. Edges with a null end
    and loops are ignored; repeated edges count once. keep: how a stage is stored.
    """
    edges = edges.select("a", "b").where("a <> b")
    edges = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
        parents = keep(parents.select("id", F.least("id", "near").alias("parent")), "parents")
        parents = _roots(parents, keep)
        left = parents.select(F.col("id").alias("a"), F.col("parent").alias("ra"))
        right = parents.select(F.col("id").alias("b"), F.col("parent").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = keep(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if labels is None:
            labels = parents.select("id", F.col("parent").alias("component"))
        else:
            step = parents.select(F.col("id").alias("component"), "parent")
            labels = labels.join(step, "component", "left")
            labels = keep(labels.select("id", F.coalesce("parent", "component").alias("component")), "labels")
    if labels is None:
        kind = edges.schema["a"].dataType
        labels = edges.select(F.col("a").cast(kind).alias("id"), F.col("b").cast(kind).alias("component")).limit(0)
    return labels


def _roots(parents: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Pointer doubling until every pointer ends at a vertex that points to itself."""
    while True:
        above = parents.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
        jumped = keep(
            parents.join(above, "parent", "left").select("id", F.coalesce("above", "parent").alias("parent"), "parent").toDF(
                "id", "parent", "was"
            ),
            "jumped",
        )
        parents = jumped.select("id", "parent")
        if jumped.where("parent <> was").isEmpty():
            return parents
