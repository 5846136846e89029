"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.tables import stage

FAN_OUT = 32


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node that can be reached.

    Each round gives a node the smallest label among its own and its neighbours', then follows labels
    twice (the label of a label), so that chains shorten at least by half; the rounds end when no label
    changes.  All steps are joins and sums of staged tables; only a count reaches the driver.  The join
    on labels has hot keys where a component is large: both of its inputs are plain tables, whose
    partitions Spark splits where they are skewed.
    """
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-both")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = stage(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")), f"{name}-lower")
        jump = lower.select(F.col("node").alias("via"), F.col("component").alias("next"))
        hopped = lower.join(jump, lower["component"] == jump["via"], "left").select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component"))
        labels = stage(hopped, f"{name}-labels")
        if not labels.where("old <> component").limit(1).count():
            return labels.select("node", "component")
        labels = labels.select("node", "component")


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that pairs join it with."""
    label = np.arange(n)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        before = label.copy()
        np.minimum.at(label, label[pairs[:, 0]], low)
        np.minimum.at(label, label[pairs[:, 1]], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
        pairs = pairs[label[pairs[:, 0]] != label[pairs[:, 1]]]
    return label


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label (of each node the smallest one it is joined with) once the pairs (i, j) are joined too."""
    a, b = label[i], label[j]
    new = a != b
    if not new.any():
        return label
    roots, place = np.unique(np.concatenate([a[new], b[new]]), return_inverse=True)
    to = np.arange(len(label))
    to[roots] = roots[forest(len(roots), place.reshape(2, -1).T)]
    return to[label]


def tree(values: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, parent) that join the values of each label by a tree with FAN_OUT children a node."""
    order = np.lexsort((values, label))
    v, lab = values[order], label[order]
    first = np.maximum.accumulate(np.where(np.r_[True, lab[1:] != lab[:-1]], np.arange(len(v)), 0))
    nth = np.arange(len(v)) - first
    child = nth > 0
    return v[child], v[(first + (nth - 1) // FAN_OUT)[child]]
