"""Trained trees as column expressions, so that scoring stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tree_column(node, features: Sequence[Column]) -> Column:
    """Nested CASE WHEN of a trained tree's root node over its features in training order."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    left, right = tree_column(node.leftChild(), features), tree_column(node.rightChild(), features)
    return F.when(features[split.featureIndex()] <= F.lit(float(split.threshold())), left).otherwise(right)


def boosted_column(model, features: Sequence[Column]) -> Column:
    """Probability of the positive class of a GBTClassificationModel (logistic loss on margins of twice the sum)."""
    total = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        total = total + tree_column(tree._call_java("rootNode"), features) * F.lit(float(weight))
    return 1.0 / (1.0 + F.exp(-2.0 * total))
