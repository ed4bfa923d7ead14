"""Connected components of an edge table, by contraction."""

from pyspark.sql import DataFrame, functions as F

from alertloom.session import cut_lineage, release


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges (a, b)``; the label is one node of the component.

    In every round each node hooks onto its smallest neighbour if that is smaller, the trees are flattened by
    pointer jumping, and the edges are rewritten between the roots. Only local minima survive a round, so the
    nodes at least halve and the rounds grow with the logarithm of the largest component. All steps are joins
    and map-side combined minima; nothing reaches the driver. An empty edge table gives an empty result.
    """
    left = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = cut_lineage(left)
    labels = None
    while not left.isEmpty():
        roots = _flatten(_hooks(left))
        if labels is None:
            labels = roots
        else:
            step = roots.select(F.col("node").alias("label"), F.col("label").alias("_next"))
            old = labels
            labels = cut_lineage(old.join(step, "label", "left").select("node", F.coalesce("_next", "label").alias("label")))
            release(old, roots)
        at_a = labels.select(F.col("node").alias("a"), F.col("label").alias("_a"))
        at_b = labels.select(F.col("node").alias("b"), F.col("label").alias("_b"))
        # labels covers the nodes of the first round, so it also holds the roots of every later one
        moved = left.join(at_a, "a").join(at_b, "b").where("_a <> _b")
        old = left
        left = cut_lineage(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        release(old)
    release(left)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    return labels


def _hooks(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
    return both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label"))


def _flatten(parents: DataFrame) -> DataFrame:
    now = cut_lineage(parents)
    while True:
        up = now.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        moved = now.join(up, "label").select("node", F.col("_up").alias("label"), (F.col("_up") != F.col("label")).alias("_moved"))
        after = cut_lineage(moved)
        release(now)
        if after.where("_moved").isEmpty():
            out = after.drop("_moved")
            out._cut_path = after._cut_path
            return out
        now = after.drop("_moved")
        now._cut_path = after._cut_path
