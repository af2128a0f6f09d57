"""Reachability over edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.scratch import Scratch


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def _walked(seeds: DataFrame, links: DataFrame, max_hops: int) -> DataFrame:
    """The same from links that every task holds: each seed is walked from in the task that has it, level by level."""
    leads: dict = {}
    for src, dst in links.collect():  # bounded by the caller
        leads.setdefault(src, []).append(dst)
    shared = seeds.sparkSession.sparkContext.broadcast(leads)
    kind = seeds.schema["seed"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads = shared.value
        for batch in batches:
            for i, seed in enumerate(batch.column(0).to_pylist()):
                seen, level, hops = {seed: 0}, [seed], 0
                while level:
                    hops += 1
                    level = [x for x in dict.fromkeys(d for n in level for d in leads.get(n, ())) if x not in seen]
                    if level and hops > max_hops:
                        raise RuntimeError(f"not all nodes were reached in {max_hops} hops")
                    seen.update(dict.fromkeys(level, hops))
                of = batch.column(0).take(pa.array([i] * len(seen)))
                yield pa.RecordBatch.from_arrays([of, pa.array(list(seen), of.type), pa.array(list(seen.values()), pa.int32())], ["seed", "node", "hops"])

    return seeds.select("seed").distinct().mapInArrow(work, f"seed {kind}, node {kind}, hops int")


def reachable(seeds: DataFrame, edges: DataFrame, max_hops: int = 1000, stride: int = 16, small: int = 200_000) -> DataFrame:
    """(seed, node, hops): every node that a seed reaches, itself included at 0 hops; cycles end by themselves.

    Up to ``small`` different edges are broadcast and walked along in the seeds' tasks, in
    one job. More are joined in rounds.

    A round goes several hops in one plan, twice as many as the round before up to
    ``stride``, and writes what is new; the next goes on from what its last hop
    found. A node leads to itself at no cost, so that a hop keeps what the hops before
    it found and the plan is one chain. Paths of 30 hops take four rounds. A lost
    executor costs one round.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    links = scratch.table(adjacency(edges).filter("src <> dst"))
    if links.count() <= small:
        return _walked(seeds, links, max_hops)
    seen = scratch.table(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops")).distinct())
    nodes = links.select("src").unionByName(links.select(F.col("dst").alias("src"))).unionByName(seen.select(F.col("node").alias("src"))).distinct()
    links = scratch.table(links.withColumn("cost", F.lit(1)).unionByName(nodes.select("src", F.col("src").alias("dst"), F.lit(0).alias("cost"))))
    frontier, done, step = seen, 0, 4
    while done < max_hops:
        at = frontier
        for _ in range(step):
            at = at.join(links, at.node == links.src).groupBy("seed", F.col("dst").alias("node")).agg(F.min(F.col("hops") + F.col("cost")).alias("hops"))
        new = scratch.table(at.join(seen.select("seed", "node"), ["seed", "node"], "left_anti"))
        before, seen = seen, scratch.table(seen.unionByName(new))
        scratch.drop(before)
        done, step = done + step, min(2 * step, stride)
        frontier = new.filter(F.col("hops") == done)
        if frontier.isEmpty():
            return seen
    raise RuntimeError(f"not all nodes were reached in {max_hops} hops")
