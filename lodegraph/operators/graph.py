"""Bounded traversal, risk, exploration, components and communities of a call graph.

Edges are (from_id, to_id).  Traversals take many seeds at once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import expressions as X
from lodegraph.storage import written


def reach(edges: DataFrame, seeds: DataFrame, depth: int, callers: bool = True) -> DataFrame:
    """seed, id, depth (least): all that reach the seeds (or are reached) within ``depth`` calls.

    A level joins the one before it with the edges and drops what earlier levels hold.  Edges and levels are
    written, so the plan of each level stays as short as the first one's; empty levels end the walk.
    """
    step = written(edges.select(F.col("to_id" if callers else "from_id").alias("at"), F.col("from_id" if callers else "to_id").alias("next")).distinct(), "steps")
    own = seeds.select(F.col("id").alias("seed"), F.col("id").alias("id")).distinct()
    front, levels = own, []
    for d in range(1, depth + 1):
        new = front.join(step, front["id"] == step["at"]).select("seed", F.col("next").alias("id")).distinct().where("id <> seed")
        if levels:
            new = new.join(reduce(DataFrame.unionByName, [x.select("seed", "id") for x in levels]), ["seed", "id"], "left_anti")
        if d < depth:
            new = written(new, "level")
        levels.append(new.withColumn("depth", F.lit(d)))
        front = new
        if d < depth and new.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def trace(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    up = reach(edges, seeds, depth, True).withColumn("direction", F.lit("caller"))
    return up.unionByName(reach(edges, seeds, depth, False).withColumn("direction", F.lit("dependency")))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("callers"))


def risk(symbols: DataFrame, edges: DataFrame, stale: DataFrame) -> DataFrame:
    """``symbols`` with callers, stale, risk = (1 + complexity)(1 + callers)(1 + stale annotations)."""
    s = stale.groupBy(F.col("symbol_id").alias("id")).agg(F.count("*").alias("stale"))
    out = symbols.join(in_degree(edges), "id", "left").join(s, "id", "left")
    out = out.withColumns({"callers": F.coalesce("callers", F.lit(0)), "stale": F.coalesce("stale", F.lit(0))})
    return out.withColumn("risk", ((1 + F.col("complexity")) * (1 + F.col("callers")) * (1 + F.col("stale"))).cast("double"))


def unexplored(symbols: DataFrame, edges: DataFrame, attention: DataFrame, more_than: int, k: int) -> DataFrame:
    """Never accessed symbols with more than so many callers, the most called first."""
    new = symbols.join(attention.select("id"), "id", "left_anti").join(in_degree(edges), "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    return new.where(F.col("callers") > more_than).orderBy(F.desc("callers"), "id").limit(k)


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """id, component (least id reached), by spreading least labels and jumping along them."""
    both = written(edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).unionAll(edges.select("to_id", "from_id")).distinct(), "links")
    label = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    for _ in range(most):
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("component").alias("m"))
        new = label.join(near, label["id"] == near["a"]).select("id", F.least("component", "m").alias("component"))
        up = label.select(F.col("id").alias("component"), F.col("component").alias("above"))
        new = written(new.join(up, "component").select("id", F.least("component", "above").alias("component")), "labels")
        if new.join(label, ["id", "component"], "left_anti").isEmpty():
            return new
        label = new
    raise RuntimeError("components did not settle")


def communities(edges: DataFrame, sweeps: int = 20) -> DataFrame:
    """id, community: one level of modularity moves in each component, in order of id; ties to the least label.

    Components are dealt out over tasks by hash.  A move depends on those before it, so one component is one task's work;
    its nodes are numbered in arrays, and after the first sweep a node is looked at again only if a neighbour or the
    weight of a community next to it has changed since, as it would stay where it is otherwise.
    """
    links = edges.where("from_id <> to_id").select("from_id", "to_id").distinct()
    links = written(links, "links")
    m = links.count() / 2.0
    comp = components(links)
    spark = edges.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    work = links.join(comp, links["from_id"] == comp["id"]).select("component", "from_id", "to_id").repartition(n, "component")

    def move(frame: pd.DataFrame) -> pd.DataFrame:
        ids, own = _moved(frame["from_id"].to_numpy(), frame["to_id"].to_numpy(), m, sweeps)
        return pd.DataFrame({"id": ids, "community": ids[own]})

    kind = edges.schema["from_id"].dataType.simpleString()
    return written(work.groupBy("component").applyInPandas(move, f"id {kind}, community {kind}"), "communities")  # moved once, read often


def _moved(a: np.ndarray, b: np.ndarray, m: float, sweeps: int) -> tuple[np.ndarray, list[int]]:
    """The nodes of a component in order, and for each the place of the node that names its community."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    n, half = len(ids), len(a)
    key = np.unique(np.concatenate([at[:half] * n + at[half:], at[half:] * n + at[:half]]))
    source, target = key // n, (key % n).tolist()
    ends = np.searchsorted(source, np.arange(n + 1)).tolist()
    weight = [float(y - x) for x, y in zip(ends, ends[1:])]
    own, total = list(range(n)), list(weight)
    changed, seen, clock = [0] * n, [-1] * n, 0  # when a community's weight or a node's label last changed; when a node was looked at
    labelled = [0] * n
    for sweep in range(sweeps):
        moved = False
        for i in range(n):
            near, mine, last = target[ends[i] : ends[i + 1]], own[i], seen[i]
            if sweep and changed[mine] <= last:
                for j in near:
                    if labelled[j] > last or changed[own[j]] > last:
                        break
                else:
                    continue
            seen[i] = clock
            shared: dict[int, int] = {}
            for j in near:
                c = own[j]
                shared[c] = shared.get(c, 0) + 1
            w = weight[i]
            kept, rest = shared.get(mine, 0), total[mine] - w
            best, gain = mine, 0.0
            for other in sorted(shared) if len(shared) > 1 else shared:
                if other != mine:
                    d = (shared[other] - kept) / m - w * (total[other] - rest) / (2 * m * m)
                    if d > gain:
                        best, gain = other, d
            if best != mine:
                clock += 1
                total[mine] -= w
                total[best] += w
                own[i], moved = best, True
                changed[mine] = changed[best] = labelled[i] = clock
        if not moved:
            break
    return ids, own


def communities_or_files(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """id, community as text: by calls where there are any, else one community for each file."""
    if edges.where("from_id <> to_id").isEmpty():
        return symbols.select("id", F.col("file").alias("community"))
    return communities(edges).select("id", F.col("community").cast("string").alias("community"))


def labels(members: DataFrame, symbols: DataFrame) -> DataFrame:
    """community, label: the longest common prefix of the members' files if it has more than two bytes
    (without closing slashes), else the file of most members (the first by name among equals).

    The common prefix of all files is that of the least and the greatest one, so no list is gathered.
    """
    filed = members.join(symbols.select("id", "file"), "id").groupBy("community", "file").agg(F.count("*").alias("n"))
    ends = filed.groupBy("community").agg(F.min("file").alias("a"), F.max("file").alias("b"), F.max(F.struct("n", F.lit(0))).alias("most"))
    usual = filed.join(ends.select("community", F.col("most.n").alias("n")), ["community", "n"]).groupBy("community").agg(F.min("file").alias("usual"))
    return ends.join(usual, "community").select("community", F.when(F.octet_length(X.common_prefix(F.col("a"), F.col("b"))) > 2, F.regexp_replace(X.common_prefix(F.col("a"), F.col("b")), "/+$", "")).otherwise(F.col("usual")).alias("label"))


def cohesion(members: DataFrame, edges: DataFrame) -> DataFrame:
    """community, size, cohesion: inner undirected edges over possible ones; 1 for a single member."""
    pairs = edges.where("from_id <> to_id").select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct()
    a = members.select(F.col("id").alias("a"), F.col("community").alias("ca"))
    b = members.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    inner = pairs.join(a, "a").join(b, "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inner_edges"))
    n = members.groupBy("community").agg(F.count("*").alias("size"))
    share = F.when(F.col("size") == 1, F.lit(1.0)).otherwise(F.coalesce("inner_edges", F.lit(0)) * 2.0 / (F.col("size") * (F.col("size") - 1)))
    return n.join(inner, "community", "left").select("community", "size", F.round(share, 6).alias("cohesion"))
