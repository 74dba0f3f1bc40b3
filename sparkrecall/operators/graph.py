"""Directed property graph: hops, shortest path, expansion (iterated joins).

Starts walk in classes. All that a start reaches, it reaches through its
out-neighbours; so starts whose only out-neighbour is the same share one walk
from that node, and any other start is a class of its own. A node other than the
start is one hop further from the start than from the class.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of up to so many rows is sent to the executors for a join.
SMALL = 100_000


class Graph:
    """Edges (src, dst, kind, weight), parallel ones kept; nodes are their ends
    and any added ones."""

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None):
        self.edges = edges
        ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
        self._ends = ends if nodes is None else ends.unionByName(nodes.select("id"))
        self.nodes = self._ends.distinct()
        # hops ignore kind and weight; parallels fall together in each step
        self.hops = edges.select("src", "dst")

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def _classes(self, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(start, class) of every start that is a node, class null if nothing leads
        away from it, and (class, id) of each class's out-neighbours."""
        known = _small(starts.select("id").distinct()).join(self._ends, "id").select(F.col("id").alias("start")).distinct()
        known = _small(known)
        links = _cut(known.join(self.hops, F.col("start") == F.col("src")).select("start", "dst").distinct())
        ends = links.groupBy("start").agg(F.min("dst").alias("lo"), F.max("dst").alias("hi"))
        one = F.col("lo") == F.col("hi")
        of = ends.select("start", F.struct(one.alias("shared"), F.when(one, F.col("lo")).otherwise(F.col("start")).alias("of")).alias("class"))
        of = _small(known.join(of, "start", "left"))
        return of, links.join(of, "start").select("class", F.col("dst").alias("id")).distinct()

    def _walk(self, starts: DataFrame, max_hops: int, cut: int) -> tuple[DataFrame, DataFrame]:
        """(start, class), and (class, id, hop) with hops counted from a start."""
        of, front = self._classes(starts)
        if max_hops < 1:
            return of, front.limit(0).withColumn("hop", F.lit(0))
        front = front.withColumn("hop", F.lit(1))
        seen = front
        for hop in range(2, max_hops + 1):
            front = _small(front)
            seen = front if hop == 2 else seen.unionByName(front)
            if front.isEmpty():
                return of, seen
            if hop % cut == 0:
                seen = _cut(seen)
            step = front.join(self.hops, front["id"] == self.hops["src"]).select("class", F.col("dst").alias("id")).distinct()
            front = step.join(seen.select("class", "id"), ["class", "id"], "left_anti").withColumn("hop", F.lit(hop))
        return of, seen.unionByName(front) if max_hops > 1 else seen

    def neighbors_within(self, starts: DataFrame, max_hops: int, cut: int = 4) -> DataFrame:
        """(start, id, hop) along out-edges for every start of ``starts`` (id)
        that is a node."""
        of, walked = self._walk(starts, max_hops, cut)
        found = walked.join(of, "class").filter(F.col("id") != F.col("start")).select("start", "id", "hop")
        return of.select("start", F.col("start").alias("id"), F.lit(0).alias("hop")).unionByName(found)

    def shortest_path(self, pairs: DataFrame, max_hops: int | None = None) -> DataFrame:
        """(src, dst, path): fewest hops, smallest path by ids among equals; a node
        to itself is one step long; unreachable or unknown pairs have no row. A class
        walks until all it is asked for is found, until it finds nothing new, or
        for ``max_hops``. ``pairs`` is read three times."""
        of, front = self._classes(pairs.select(F.col("src").alias("id")))
        asked = pairs.select("src", "dst").join(of.withColumnRenamed("start", "src"), "src")
        wanted = _cut(asked.filter("class is not null and src <> dst").select("class", "dst").distinct())
        front = _small(front.select("class", F.col("id").alias("at"), F.array("id").alias("path")))
        seen = front.select("class", "at")
        done = front.limit(0).withColumnRenamed("at", "dst")
        for hop in count(1) if max_hops is None else range(1, max_hops + 1):
            if hop > 1:
                step = front.join(self.hops, front["at"] == self.hops["src"])
                step = step.select("class", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
                front = _small(step.groupBy("class", "at").agg(F.min("path").alias("path")).join(seen, ["class", "at"], "left_anti"))
                seen = _cut(seen.unionByName(front.select("class", "at")))
            found = _cut(front.withColumnRenamed("at", "dst").join(wanted, ["class", "dst"], "left_semi"))
            done = done.unionByName(found)
            wanted = _cut(wanted.join(found, ["class", "dst"], "left_anti"))
            front = front.join(_small(wanted.select("class").distinct()), "class", "left_semi")
            if front.isEmpty():
                break
        # one exchange of the pairs serves the join and drops those that stand twice
        asked = asked.repartition("class", "dst").dropDuplicates(["class", "dst", "src"])
        out = asked.join(done, ["class", "dst"], "left").select("src", "dst", F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.concat(F.array("src"), "path")).alias("path"))
        return out.filter("path is not null")

    def expand(self, seeds: DataFrame, max_hops: int, limit: int) -> DataFrame:
        """(id, seed_ord, hop): neighbours of ``seeds`` (id, seed_ord) in seed
        order, then hop, then id; walks pass through seeds, which are left out."""
        of, walked = self._walk(seeds, max_hops, 4)
        # of a class only the first seed counts: the seeds themselves are left out
        first = of.join(seeds.withColumnRenamed("id", "start"), "start").groupBy("class").agg(F.min("seed_ord").alias("seed_ord"))
        best = walked.join(_small(first), "class").groupBy("id").agg(F.min(F.struct("seed_ord", "hop")).alias("b"))
        best = best.join(_small(seeds.select("id").distinct()), "id", "left_anti").select("id", "b.seed_ord", "b.hop")
        return best.orderBy("seed_ord", "hop", "id").limit(max(0, limit))


def _small(df: DataFrame) -> DataFrame:
    """Cut, and sent to the executors for a join if it has few rows."""
    df = _cut(df)
    return F.broadcast(df) if df.count() <= SMALL else df


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="sparkrecall-graph-"))
    return df.checkpoint()
