"""The link graph: nodes and merged edges, shortest paths between cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identity import within_hops
from .storage import cut

# Edge statuses from the weakest.
RANKS = ("inferred", "pending", "recorded", "confirmed")


def rank(column: str = "status"):
    return F.array_position(F.array(*map(F.lit, RANKS)), F.col(column))


def merged_edges(edges: DataFrame) -> DataFrame:
    """One edge per endpoints and kind, with its strongest status and how many stand behind it."""
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    e = edges.where("src <> dst").select(lo.alias("src"), hi.alias("dst"), "kind", "status", rank().alias("_r"))
    g = e.groupBy("src", "dst", "kind").agg(F.max_by("status", "_r").alias("status"), F.count(F.lit(1)).alias("weight"))
    return g


def appear_edges(mentions: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Case - entity edges of candidates; those kept separate have none across cases."""
    m = mentions.select(F.concat(F.lit("case:"), "case_id").alias("src"), F.concat(F.lit("entity:"), "candidate_id").alias("dst"), "candidate_id").distinct()
    if decisions is not None:
        m = m.join(decisions.select("candidate_id", "decision"), "candidate_id", "left").where(F.coalesce("decision", F.lit("")) != "KEEP_SEPARATE")
        status = F.when(F.col("decision") == "MERGE", "confirmed").otherwise("pending")
    else:
        status = F.lit("pending")
    return m.select("src", "dst", F.lit("appear").alias("kind"), status.alias("status"))


def shortest_paths(edges: DataFrame, start: str, prefix: str, most: int = 6, limit: int = 2) -> DataFrame:
    """(node, distance, path) of the nearest nodes whose name starts with `prefix`, over appear and
    cooccur edges that are not inferred. Breadth first; of several ways the least predecessor is
    taken. The limit is the feature."""
    walk = edges.where(F.col("kind").isin("appear", "cooccur") & (F.col("status") != "inferred"))
    both = walk.select("src", "dst").union(walk.select(F.col("dst"), F.col("src"))).distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0, [start])], "node string, distance int, path array<string>")
    front = seen
    for k in range(1, most + 1):
        step = front.join(both, front["node"] == both["src"]).select(F.col("dst"), F.col("path"), F.col("node"))
        step = step.groupBy("dst").agg(F.min_by("path", "node").alias("p")).select(F.col("dst").alias("node"), F.lit(k).alias("distance"), F.concat("p", F.array("dst")).alias("path"))
        front = cut(step.join(seen.select("node"), "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where(F.col("node").startswith(prefix) & (F.col("node") != start)).orderBy("distance", "node").limit(limit)


def _party_keys(kind: Column, subject: Column, surfaces: list[Column]) -> Column:
    """(rank, key) in the order in which a party is looked up: subject id, typed surfaces as written, without
    blanks, and as digits."""
    keys = [F.when(F.trim(F.coalesce(subject, F.lit(""))) != "", F.struct(F.lit(0).alias("rank"), F.concat(F.lit("id:"), F.trim(subject)).alias("key")))]
    for k, s in enumerate(surfaces):
        s = F.trim(F.coalesce(s, F.lit("")))
        d = F.regexp_replace(s, "[^0-9]", "")
        for j, (ok, x) in enumerate(((s != "", F.lower(s)), (s != "", F.lower(F.regexp_replace(s, r"\s+", ""))), (F.length(d) >= 4, F.concat(F.lit("d:"), d)))):
            keys.append(F.when(ok, F.struct(F.lit(1 + 3 * k + j).alias("rank"), F.concat_ws(":", kind, x).alias("key"))))
    return F.array_compact(F.array(*keys))


def resolved_parties(parties: DataFrame, nodes: DataFrame) -> DataFrame:
    """(party_id, node_id, rank): the node that a party of an event stands for, by the first of its keys that a
    node has; parties without one are left out. parties and nodes: (party_id or node_id, object_type,
    subject_id, surface, normalized_value). A key that several nodes have is that of the
    one that has it most directly, the smaller id of equals, so a common key is one row; a party
    keeps the least rank of its few keys."""
    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select(name, F.explode(_party_keys(F.col("object_type"), F.col("subject_id"), [F.col("surface"), F.col("normalized_value")])).alias("x")).select(name, "x.rank", "x.key")

    index = keyed(nodes, "node_id").groupBy("key").agg(F.min(F.struct("rank", "node_id")).alias("m")).select("key", "m.node_id")
    best = keyed(parties, "party_id").join(index, "key").groupBy("party_id").agg(F.min(F.struct("rank", "node_id")).alias("m"))
    return best.select("party_id", "m.node_id", "m.rank")


EVENT_EDGES = ("act", "involve", "sequence", "event-case")


def default_node(nodes: DataFrame) -> DataFrame:
    """(node_id): the node that a view starts from: of entities that bridge cases, else of entities that are no
    breakpoint, the one of most cases, then of the highest status; else a case, else any; the smaller
    id of equals. A least of ranked structs, so no node list is gathered."""
    entity = F.col("kind") == "entity"
    tier = F.when(entity & F.coalesce("bridge", F.lit(False)), 0).when(entity & ~F.coalesce("breakpoint", F.lit(False)), 1).when(F.col("kind") == "case", 2).otherwise(3)
    score = F.when(tier < 2, -F.size(F.coalesce("case_ids", F.array().cast("array<string>")))).otherwise(0)
    order = F.struct(tier.alias("tier"), score.alias("n"), F.when(tier < 2, -rank()).otherwise(0).alias("status"), "node_id")
    return nodes.agg(F.min(order).alias("m")).where("m is not null").select("m.node_id")


def filtered(nodes: DataFrame, edges: DataFrame, hide_weak: bool = False, events: bool = True, case: str | None = None, status: str | None = None, entity_type: str | None = None, core: bool = False) -> tuple[DataFrame, DataFrame]:
    """A view's nodes and edges. Cases pass the filters of status and type, events those of weakness and
    type. With `core` only cases and entities that bridge them stay, beside what the default one of these
    occurs with. nodes: (node_id, kind, entity_type, status, case_ids, bridge, breakpoint); edges: (src,
    dst, kind, strength)."""
    kind, cases = F.col("kind"), F.coalesce("case_ids", F.array().cast("array<string>"))
    n, e = nodes, edges
    if hide_weak:
        e = e.where("coalesce(strength, '') <> 'weak'")
        n = n.where((F.coalesce("status", F.lit("")) != "inferred") | kind.isin("case", "event"))
    if not events:
        n, e = n.where(kind != "event"), e.where(~F.col("kind").isin(*EVENT_EDGES))
    if case is not None:
        n = n.where(F.when(kind == "case", F.col("node_id") == f"case:{case}").otherwise(F.array_contains(cases, case)))
    if status is not None:
        n = n.where((kind == "case") | (F.col("status") == status))
    if entity_type is not None:
        n = n.where(kind.isin("case", "event") | (F.col("entity_type") == entity_type))
    if core:
        inner = n.where((kind == "case") | ((kind == "entity") & F.coalesce("bridge", F.lit(False))))
        start = F.broadcast(default_node(inner))  # one row
        near = e.where("kind = 'cooccur'").join(start, (F.col("src") == F.col("node_id")) | (F.col("dst") == F.col("node_id")))
        near = near.select(F.when(F.col("src") == F.col("node_id"), F.col("dst")).otherwise(F.col("src")).alias("node_id"))
        keep = inner.select("node_id").union(near).distinct()
        n = n.join(keep, "node_id", "left_semi")
    ids = n.select("node_id").distinct()
    e = e.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return n, e


def core_view(nodes: DataFrame, edges: DataFrame, selected: str | None = None, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """What a view shows at first, of nodes and edges as `filtered` leaves them: cases, entities that bridge
    them, what occurs with the start, and events with an edge to one of these; if any entity bridges cases,
    of all but the cases only what is at most `hops` edges from the start over what is left.
    Entities that are a breakpoint need an edge. The start is the selected node where it is a case or
    bridges cases, else the default one of these. Events that are linked with kept events only stay out,
    so that the result doesn't depend on the nodes' order. Without nodes the view is empty.

    Nodes are marked as core or event, and an edge is shuffled for its second end only if the first one is
    marked; only edges between marked nodes are written."""
    kind = F.col("kind")
    bridge = (kind == "entity") & F.coalesce("bridge", F.lit(False))
    inner = nodes.where((kind == "case") | bridge)
    picked = inner.where(F.lit(False)).select("node_id") if selected is None else inner.where(F.col("node_id") == selected).select("node_id").distinct()
    first = F.min(F.struct("second", "node_id")).alias("m")
    rows = picked.withColumn("second", F.lit(False)).unionByName(default_node(inner).withColumn("second", F.lit(True)))
    start = cut(rows.agg(first).where("m is not null").select("m.node_id"))  # one row
    near = edges.where("kind = 'cooccur' and src <> dst").select("src", "dst").join(F.broadcast(start), (F.col("src") == F.col("node_id")) | (F.col("dst") == F.col("node_id")))
    near = near.select(F.when(F.col("src") == F.col("node_id"), F.col("dst")).otherwise(F.col("src")).alias("node_id"))
    mark = lambda df, core, told, here: df.select("node_id", core.alias("core"), told.alias("event"), F.lit(here).alias("here"))
    marks = mark(nodes, (kind == "case") | bridge, kind == "event", True).unionByName(mark(near, F.lit(True), F.lit(False), False))
    marks = marks.groupBy("node_id").agg(*(F.bool_or(c).alias(c) for c in ("core", "event", "here"))).where("here and (core or event)").drop("here")
    # an event's edges point to what it names, so the ends that fewer nodes pass are looked at first
    met = edges
    for end in ("dst", "src"):
        met = met.hint("merge").join(marks.select(F.col("node_id").alias(end), F.col("core").alias(f"_{end}_core"), F.col("event").alias(f"_{end}_event")).hint("merge"), end)
    met = cut(met)
    told = met.where("_src_event and _dst_core").select(F.col("src").alias("node_id")).union(met.where("_dst_event and _src_core").select("dst")).distinct()
    among = lambda e, held: e.join(held.withColumnRenamed("node_id", "src").hint("merge"), "src", "left_semi").join(held.withColumnRenamed("node_id", "dst").hint("merge"), "dst", "left_semi").select(*edges.columns)
    e = met.where("_src_core or _dst_core").select(*edges.columns).unionByName(among(met.where("not (_src_core or _dst_core)"), told))
    if nodes.where(bridge).isEmpty():
        seen = marks.where("core").select("node_id").union(told)
    else:
        seen = within_hops(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), start.withColumnRenamed("node_id", "node"), hops).select(F.col("node").alias("node_id"))
        seen = seen.union(nodes.where("kind = 'case'").select("node_id"))
    seen = cut(seen.distinct())
    n, e = nodes.join(seen.hint("merge"), "node_id", "left_semi"), cut(among(e, seen))
    linked = e.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    alone = n.where((kind == "entity") & F.coalesce("breakpoint", F.lit(False))).join(linked, "node_id", "left_anti").select("node_id")
    return n.join(alone, "node_id", "left_anti"), e
