"""Prefix trie of conversations; subtree totals by leaf peeling.

Turns are thin rows (a digest and a length) from the first read on; no text is shuffled. A turn's
place is its rank in its slice of turn numbers plus the turns of the slices before, so a conversation
of any length is dealt to many tasks. A prefix is named by two 64-bit sums (xor) of the hashes of
(turn, place), which slices add up independently; a node is all members of one name and depth, and
is known by (smallest member, depth) from there on.

Totals go up by messages. A node holds how many of its children are still open and the xor of their
ids. A completed node sends its totals to its parent, which adds them and counts down; at zero it is
complete itself. A node with one open child left knows it from the xor: it waits for that child by a
link, and links of links are doubled, so a chain of n turns takes log n rounds and not n. Rounds end
when the root is complete. Messages are added before they are shuffled, a hot parent's too. Each
round is written to the shared folder and the one before is deleted; completed nodes leave the state.

The members that end at a node are hashed in order of their ids: texts of up to `RUN` neighbouring
ids are made apart, and one pass over a node's runs hashes them, however many they are.

Null roles and texts are empty. Turns of one number are ordered by role, then by their text's digest
(a slice holds all turns of one number); rows repeated in full are turns each. Rows without a
conv_id belong to none and are left out. Texts of any length count whole. An empty table has no
nodes. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

GROUP, HEADS = 100, 6  # leaders are the multiples of GROUP; h is below HEADS
SLICE, RUN = 1024, 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def _mark(turn: str, place: Column, seed: int) -> Column:
    return F.xxhash64(F.col(turn), place.cast("long"), F.lit(seed))


def _placed(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, s, r, x, points) with their rank in slice s, and slices (c, s, n, before)."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn").cast("long").alias("t"),
        role.alias("role"),
        F.unhex(F.sha2(text, 256)).alias("d"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("x"),
        F.char_length(text).cast("long").alias("points"),
    )
    turns = turns.withColumn("s", F.coalesce(F.floor(F.col("t") / SLICE), F.lit(-(1 << 62))))
    w = Window.partitionBy("c", "s").orderBy(F.col("t").asc_nulls_first(), "role", "d")
    turns = common.written(turns.withColumn("r", F.row_number().over(w)).select("c", "s", "r", "x", "points"))
    w = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    slices = turns.groupBy("c", "s").agg(F.count(F.lit(1)).alias("n"))
    return turns, slices.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def members(conversations: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation: (c, depth, k1, k2, p1, p2, points, last), where p is
    the prefix one turn shorter (null for the empty prefix) and `last` marks the whole conversation."""
    turns, slices = _placed(conversations)
    slices = common.written(slices)
    heads = turns.join(slices.where(f"before < {HEADS - 1} and c % {GROUP} = 0"), ["c", "s"]).withColumn("i", F.col("before") + F.col("r")).where(f"i < {HEADS}")
    leaders = heads.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("i", "x", "points"))).alias("heads"))  # fewer than HEADS each
    leaders = leaders.withColumnRenamed("c", "leader")
    h = F.crc32(F.col("c").cast("string").cast("binary")) % HEADS
    convs = slices.groupBy("c").agg(F.sum("n").alias("own")).withColumn("h", h.cast("int")).withColumn("leader", F.col("c") - F.col("c") % GROUP)
    convs = convs.join(leaders, "leader", "left").withColumn("heads", F.expr("coalesce(slice(heads, 1, h), filter(array(cast(null as struct<i: bigint, x: binary, points: bigint>)), q -> false))"))
    for seed in (1, 2):  # the names of the leader's prefixes
        convs = convs.withColumn(f"b{seed}", F.expr(f"aggregate(heads, array(0L), (a, q) -> array_append(a, element_at(a, -1) ^ xxhash64(q.x, q.i, {seed})))"))
    convs = convs.withColumn("k", F.size("heads"))
    convs = common.written(convs.withColumn("len", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    # the leader's part
    taken = convs.select("c", "len", "b1", "b2", F.posexplode("heads").alias("i", "q"))
    taken = taken.select("c", (F.col("i") + 1).cast("long").alias("depth"), *(F.expr(f"element_at(b{s}, i + 2)").alias(f"k{s}") for s in (1, 2)), *(F.expr(f"element_at(b{s}, i + 1)").alias(f"p{s}") for s in (1, 2)), F.col("q.points").alias("points"), "len")
    # the conversation's own part: names within slices, then those of the slices before
    base = convs.select("c", "h", "k", "len", F.element_at("b1", -1).alias("b1"), F.element_at("b2", -1).alias("b2"))
    info = common.written(slices.join(base, "c").drop("n"))
    own = turns.join(info.select("c", "s", "before", "h", "k"), ["c", "s"])
    own = own.withColumn("depth", F.col("before") + F.col("r") + F.col("k") - F.col("h")).where("before + r > h")
    w = Window.partitionBy("c", "s").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumns({f"g{s}": _mark("x", F.col("depth"), s) for s in (1, 2)}).withColumns({f"l{s}": F.bit_xor(f"g{s}").over(w) for s in (1, 2)})
    own = common.written(own.select("c", "s", "r", "depth", "g1", "g2", "l1", "l2", "points"))
    sums = own.groupBy("c", "s").agg(*(F.max_by(f"l{s}", "r").alias(f"t{s}") for s in (1, 2)))
    w = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    info = info.join(sums, ["c", "s"], "left").withColumns({f"a{s}": F.coalesce(F.bit_xor(f"t{s}").over(w), F.lit(0)).bitwiseXOR(F.col(f"b{s}")) for s in (1, 2)})
    own = own.join(info.select("c", "s", "a1", "a2", "len"), ["c", "s"])
    own = own.withColumns({f"k{s}": F.col(f"a{s}").bitwiseXOR(F.col(f"l{s}")) for s in (1, 2)})
    own = own.select("c", "depth", "k1", "k2", *(F.col(f"k{s}").bitwiseXOR(F.col(f"g{s}")).alias(f"p{s}") for s in (1, 2)), "points", "len")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("c", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("points"), "len")
    return taken.unionByName(own).unionByName(root).withColumn("last", F.col("depth") == F.col("len")).drop("len")


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of (depth, k1, k2, c)."""
    runs = ends.groupBy("depth", "k1", "k2", F.floor(F.col("c") / RUN).alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))  # at most RUN ids
    name = ["depth", "k1", "k2"]
    dealt = runs.repartition(common.partitions(ends.sparkSession), *name).sortWithinPartitions(*name, "run")

    def run(batches):
        now, sha, out = None, None, []

        def flushed():
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 3 + (pa.string(),), strict=True)], names=[*name, "ends_sha256"])
            out.clear()
            return done

        for rb in batches:
            for *node, ids in zip(*(rb.column(x).to_pylist() for x in (*name, "ids")), strict=True):
                if node != now:
                    if now:
                        out.append((*now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if len(out) > 4096:
                yield flushed()
        if now:
            out.append((*now, sha.hexdigest()))
            yield flushed()

    return dealt.select(*name, "ids").mapInArrow(common.trimming(run), "depth long, k1 long, k2 long, ends_sha256 string")


def peeled(nodes: DataFrame, *totals: str) -> DataFrame:
    """Subtree sums of the columns `totals` (long) over nodes (id, depth, parent, ...), where a node is (id,
    depth) and its parent (parent, depth - 1), null at the root: (id, depth, totals)."""
    spark = nodes.sparkSession
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("_p"), (F.col("depth") - 1).alias("_d"))
    kids = kids.agg(F.count(F.lit(1)).alias("open"), F.bit_xor("id").alias("kids"))
    base = nodes.select("id", "depth", "parent", *totals).join(kids, (F.col("id") == F.col("_p")) & (F.col("depth") == F.col("_d")), "left").drop("_p", "_d")
    # link: the one open child that is waited for; a completed node has open = 0
    state = base.withColumn("open", F.coalesce("open", F.lit(0)).cast("long")).withColumn("kids", F.coalesce("kids", F.lit(0)))
    link = lambda d: d.withColumn("link", F.coalesce("link", F.when(F.col("open") == 1, F.col("kids")))).withColumn("link_depth", F.coalesce("link_depth", F.when(F.col("open") == 1, F.col("depth") + 1)))
    state = link(state.withColumn("link", F.lit(None).cast("long")).withColumn("link_depth", F.lit(None).cast("long")))
    cols = ["id", "depth", "parent", *totals, "open", "kids", "link", "link_depth"]
    done, before = None, None
    while True:
        path = f"{common.shared_folder(spark)}/round"
        state.select(*cols, (F.col("open") == 0).alias("complete")).write.partitionBy("complete").parquet(path)
        now = spark.read.schema(state.select(*cols, F.lit(True).alias("complete")).schema).parquet(path)
        fresh, active = now.where("complete").drop("complete"), now.where("not complete").drop("complete")
        got = fresh.select("id", "depth", *totals)
        done = got if done is None else done.unionByName(got)
        if before:
            common.deleted(spark, f"{before}/complete=false")
        before = path
        if active.isEmpty():
            return done
        # messages to nodes that are still counting
        sent = fresh.where("parent is not null").groupBy(F.col("parent").alias("_p"), (F.col("depth") - 1).alias("_d"))
        sent = sent.agg(F.count(F.lit(1)).alias("_n"), F.bit_xor("id").alias("_x"), *(F.sum(t).alias(f"_{t}") for t in totals))
        counting = active.where("link is null").join(sent, (F.col("id") == F.col("_p")) & (F.col("depth") == F.col("_d")), "left")
        plus = {t: F.col(t) + F.coalesce(f"_{t}", F.lit(0)) for t in totals}
        counting = counting.withColumns(plus | {"open": F.col("open") - F.coalesce("_n", F.lit(0)), "kids": F.col("kids").bitwiseXOR(F.coalesce("_x", F.lit(0)))})
        # waiting nodes end with what they wait for, or wait for what that waits for
        waiting = active.where("link is not null")
        ended = fresh.select(F.col("id").alias("_i"), F.col("depth").alias("_d"), F.lit(True).alias("_done"), *(F.col(t).alias(f"_{t}") for t in totals))
        at = (F.col("link") == F.col("_i")) & (F.col("link_depth") == F.col("_d"))
        waiting = waiting.join(ended, at, "left")
        ends = waiting.where("_done").withColumns(plus | {"open": F.lit(0).cast("long")}).select(*cols)
        rest = common.written(waiting.where("_done is null").select(*cols))
        on = rest.select(F.col("id").alias("_i"), F.col("depth").alias("_d"), F.col("link").alias("_l"), F.col("link_depth").alias("_ld"), *(F.col(t).alias(f"_{t}") for t in totals))
        jumped = rest.join(on, at, "left").withColumns(plus | {"link": F.coalesce("_l", "link"), "link_depth": F.coalesce("_ld", "link_depth")}).select(*cols)
        state = link(counting.select(*cols)).unionByName(ends).unionByName(jumped)


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node: the columns of the contract."""
    every = common.written(members(conversations))
    name = ["depth", "k1", "k2"]
    nodes = every.groupBy(*name).agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("points").alias("points"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = common.written(nodes)
    up = nodes.select((F.col("depth") + 1).alias("_d"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(up, (F.col("depth") == F.col("_d")) & (F.col("p1") == F.col("_k1")) & (F.col("p2") == F.col("_k2")), "left").drop("_d", "_k1", "_k2", "p1", "p2")
    nodes = common.written(nodes)
    kids = nodes.where("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("_c"), (F.col("depth") - 1).alias("_d")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left").drop("_c", "_d")
    nodes = common.written(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = nodes.select(F.col("conv_id").alias("id"), "depth", F.col("parent_conv_id").alias("parent"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved_tokens"))
    totals = peeled(own, "n_leaves", "saved_tokens").withColumnsRenamed({"id": "_c", "depth": "_d"})
    ends = _ends(every.where("last").select(*name, "c")).withColumnsRenamed({"depth": "_d", "k1": "_k1", "k2": "_k2"})
    out = nodes.join(ends, (F.col("depth") == F.col("_d")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left").drop("_d", "_k1", "_k2")
    out = out.join(totals, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d")))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(common.table(spark, sf_dir, "conversations"))


SQL = f"""
WITH t AS MATERIALIZED (SELECT conv_id AS c, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, length(coalesce(text, '')) AS points,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), unhex(sha256(coalesce(text, '')))) AS i FROM conversations WHERE conv_id IS NOT NULL),
conv AS MATERIALIZED (SELECT c, c - c % {GROUP} AS leader, (xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, [ascii(z)::UBIGINT FOR z IN string_split(c::VARCHAR, '')]),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]), lambda y, _: xor(y >> 1, (y & 1) * 3988292384::UBIGINT)))) % {HEADS})::BIGINT AS h FROM (SELECT DISTINCT c FROM t)),
rebuilt AS (SELECT conv.c, 0 AS part, t.i, t.x, t.points FROM conv JOIN t ON t.c = conv.leader AND t.i <= h UNION ALL SELECT conv.c, 1, t.i, t.x, t.points FROM conv JOIN t ON t.c = conv.c AND t.i > h),
pre AS MATERIALIZED (SELECT c, row_number() OVER w AS depth, string_agg(x, '' ) OVER (PARTITION BY c ORDER BY part, i ROWS UNBOUNDED PRECEDING) AS name, points FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, i)
  UNION ALL SELECT c, 0, '', 0 FROM conv),
mem AS MATERIALIZED (SELECT c, depth, points, min(c) OVER (PARTITION BY depth, name) AS node, max(depth) OVER (PARTITION BY c) AS len FROM pre),
nodes AS MATERIALIZED (SELECT node AS conv_id, depth, count(*) AS n_convs, max(points) AS points, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = len), '')) AS ends_sha256 FROM mem GROUP BY ALL),
up AS MATERIALIZED (SELECT n.*, m.node AS parent_conv_id FROM nodes n LEFT JOIN mem m ON m.c = n.conv_id AND m.depth = n.depth - 1),
kid AS MATERIALIZED (SELECT u.*, (SELECT count(*) FROM up k WHERE k.parent_conv_id = u.conv_id AND k.depth = u.depth + 1) AS n_children FROM up u),
total AS (SELECT a.node AS conv_id, a.depth, sum((k.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((k.n_convs - 1) * k.points)::BIGINT AS saved_tokens FROM kid k JOIN mem a ON a.c = k.conv_id AND a.depth <= k.depth GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM kid JOIN total USING (conv_id, depth)
"""
