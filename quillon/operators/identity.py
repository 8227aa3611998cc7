"""Alias components, subject resolution, graphs, versions and closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut as _cut

PIECE = 500_000  # rows of a task that keeps them in memory


def pieces(df: DataFrame, rows: int = PIECE) -> int:
    """How many partitions keep a task to some `rows` of df. They are counted, as short keys pack so well
    that the size of a shuffle says little of the memory that its rows take."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected links (a, b): labels spread to neighbours and, through label
    chains, jump ahead, until nothing changes. Each round is two aggregated joins."""
    both = _cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
    label = _cut(label)
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        step = label.join(near, "node").select("node", F.least("root", "m").alias("r"))
        jump = step.join(label.select(F.col("node").alias("r"), F.col("root").alias("rr")), "r", "left")
        new = _cut(jump.select("node", F.coalesce(F.least("r", "rr"), "r").alias("root")))
        if new.join(label, ["node", "root"], "left_anti").isEmpty():
            return new
        label = new


def resolve_subjects(parties: DataFrame, index: DataFrame) -> DataFrame:
    """Party surfaces take the subject of the index (surface first, then display name), else auto."""
    by = index.groupBy("surface").agg(F.max_by("subject_id", "decided_at").alias("subject_id"))
    s1, s2 = by.select(F.col("surface"), F.col("subject_id").alias("s1")), by.select(F.col("surface").alias("display_name"), F.col("subject_id").alias("s2"))
    j = parties.join(s1, "surface", "left").join(s2, "display_name", "left")
    return j.withColumn("subject_id", F.coalesce("s1", "s2", F.concat(F.lit("auto:"), F.col("surface")))).drop("s1", "s2")


def sequence_edges(events: DataFrame, subject: str, ts: str, key: str) -> DataFrame:
    """Consecutive events of each subject."""
    w = Window.partitionBy(subject).orderBy(ts, key)
    nxt = events.select(subject, F.col(key).alias("event_from"), F.lead(key).over(w).alias("event_to"), F.col(ts).alias("at"), F.lead(ts).over(w).alias("next_at"))
    return nxt.where("event_to is not null")


def cooccurrence(members: DataFrame, group: str, item: str, least: int = 1) -> DataFrame:
    """Pairs i < j that share groups, with their number. For groups of bounded size (a document's
    or an event's parties): a group of n gives n (n - 1) / 2 pairs."""
    m = members.select(F.col(group).alias("_g"), F.col(item).alias("i"))
    n = pieces(m)
    m = m.repartition(n, "_g").distinct()
    pairs = m.join(m.withColumnRenamed("i", "j").hint("merge"), "_g").where("i < j").select("i", "j")
    pairs = pairs.repartition(2 * n, "i", "j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    return pairs.where(F.col("n") >= least)


def within_hops(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, distance) of nodes at most `hops` away; visited nodes are not met again."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("distance"))
    edge = seen
    for k in range(1, hops + 1):
        step = edge.join(both, edge["node"] == both["a"]).select("start", F.col("b").alias("node")).distinct()
        edge = step.join(seen, ["start", "node"], "left_anti").withColumn("distance", F.lit(k))
        seen = seen.unionByName(edge)
    return seen


def closure(parents: DataFrame, changed: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """Artifacts downstream of the changed ones: (node, depth). Frozen ones are passed through
    and left out at the end."""
    seen = _cut(changed.select("node", F.lit(0).alias("depth")).distinct())
    front, k = seen, 0
    while True:
        k += 1
        step = front.join(parents, front["node"] == parents["parent"]).select(F.col("child").alias("node")).distinct()
        front = _cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(k)))
        if front.isEmpty():
            break
        seen = _cut(seen.unionByName(front))
    out = seen.where("depth > 0")
    return out if frozen is None else out.join(frozen, "node", "left_anti")


def merge_candidates(decided: DataFrame, new: DataFrame, carried: DataFrame, key: str = "fingerprint") -> DataFrame:
    """One row per key: decided before new before carried over, as one aggregation."""
    rows = decided.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1))).unionByName(carried.withColumn("_p", F.lit(2)))
    rest = [c for c in rows.columns if c not in (key, "_p")]
    best = rows.groupBy(key).agg(F.min(F.struct("_p", *rest)).alias("v"))
    return best.select(key, F.col("v._p").alias("priority"), *(F.col(f"v.{c}").alias(c) for c in rest))
