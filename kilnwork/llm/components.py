"""Connected components of a table of links, by repeated contraction in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize, release


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over links a-b."""
    lab = np.arange(n)
    while len(a) and not np.array_equal(lab[a], lab[b]):
        low = np.minimum(lab[a], lab[b])
        np.minimum.at(lab, lab[a], low)
        np.minimum.at(lab, lab[b], low)
        lab = lab[lab]
    while not np.array_equal(lab, lab[lab]):
        lab = lab[lab]
    return lab


#: So many links are few enough for one task.
FEW = 1 << 20


def labelled(links: DataFrame) -> DataFrame:
    """(node, root) of at most FEW links, all in one task, whose memory that bounds."""
    kind = links.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("a"), b.column("b")) for b in batches]
        n = sum(len(a) for a, _ in held)
        ends = pa.chunked_array([a for a, _ in held] + [b for _, b in held], held[0][0].type).combine_chunks().dictionary_encode() if n else None
        if n:
            at, names = ends.indices.to_numpy(), ends.dictionary
            roots = names.take(pa.array(local_labels(len(names), at[:n], at[n:])))
            for i in range(0, len(names), 1 << 16):
                yield pa.record_batch([names[i : i + (1 << 16)], roots[i : i + (1 << 16)]], ["node", "root"])

    return links.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def components(links: DataFrame, name: str = "cc", few: int = FEW) -> DataFrame:
    """(node, root) for every node of `links` (a, b); nodes of one component share a root, one of them.

    Each round every node points to the neighbour whose seeded hash is least (or to itself), links are renamed to these
    and loops and repeats go; in expectation a constant share of the nodes goes with each round. The counts that end the
    loop are all that reaches the driver. Once few enough links are left one task labels them. Null ends and loops are dropped.
    """
    live = materialize(links.where("a <> b").select("a", "b").distinct(), f"{name}-links0")
    maps, step = [], 0
    while live.count() > few:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.xxhash64(F.lit(step), c)  # noqa: B023, E731
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(rank("a").alias("r"), F.col("a").alias("n"))
        to = materialize(best.select(F.col("a").alias("node"), F.least(own, F.col("m")).getField("n").alias("root")), f"{name}-map{step}")
        maps.append(to)
        left, right = to.toDF("a", "ra"), to.toDF("b", "rb")
        before, live = live, materialize(live.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-links{step + 1}")
        release(before)
        step += 1
    maps.append(materialize(labelled(live), f"{name}-map{step}"))
    follow = lambda x, y: x.join(y.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return reduce(follow, maps)
