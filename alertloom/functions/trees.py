"""Fitted tree ensembles as expressions.

A tree is nested tuples ``(feature, threshold, left, right)`` with a probability at each leaf; rows with a value at
most the threshold go left. A vote is compiled with the plan that uses it: no model is shipped, and no row leaves
generated code.
"""

from functools import reduce

from pyspark.sql import Column, functions as F

from .pairs import pair_features


def forest_trees(model, features) -> list:
    """The trees of a fitted binary Spark forest or tree. A model has a fixed number of nodes, whatever it was fitted on."""
    members = model.trees if hasattr(model, "trees") else [model]
    return [_tree(m._call_java("rootNode"), features) for m in members]


def _tree(node, features):
    if node.getClass().getSimpleName() == "LeafNode":
        counts = list(node.impurityStats().stats())
        return counts[1] / sum(counts)
    split = node.split()
    return (features[split.featureIndex()], split.threshold(), _tree(node.leftChild(), features), _tree(node.rightChild(), features))


def tree_probability(tree, values: dict) -> Column:
    """The leaf's probability as an expression over ``values``, columns by feature name."""
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, threshold, left, right = tree
    return F.when(values[feature].cast("double") <= F.lit(float(threshold)), tree_probability(left, values)).otherwise(tree_probability(right, values))


def forest_probability(trees, values: dict) -> Column:
    """Mean of the trees' probabilities, summed in their order."""
    return reduce(lambda x, y: x + y, [tree_probability(t, values) for t in trees]) / F.lit(float(len(trees)))


def forest_decision(trees, threshold: float = 0.5):
    """Link when the ensemble's probability lies above the threshold."""
    def decide(a: Column, c: Column) -> Column:
        return forest_probability(trees, pair_features(a, c)) > F.lit(float(threshold))
    return decide
