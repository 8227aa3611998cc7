"""The redaction ledger as state: batches of changes and span repair, and the chunks they rebuild.

Ledger rows are (item_id, chunk_id, char_start, char_end, placeholder, map_ref, sens_type) in places of
the raw text; mappings are (fingerprint, anonymous_id, sens_type). Only chunks that a change touches
are rebuilt; of those the result is whole, with the place of each placeholder in the new text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import persons
from . import citations, ledger, live, search, spans, storage

PERSONS = ("PERSON", "NAME")
PHONES = ("PHONE", "PHONE_NUMBER", "CN_PHONE_NUMBER", "MOBILE")
ITEM = ("item_id", "chunk_id", "char_start", "char_end", "placeholder", "map_ref", "sens_type")
_NO_SPANS = "array<struct<char_start:int,char_end:int>>"


def placed(items: DataFrame) -> DataFrame:
    """Adds new_start and new_end: where a placeholder stands in the rebuilt text. Each replacement
    shifts all later ones of its chunk by its change of length, so the shift is a prefix sum."""
    grown = F.length("placeholder") - (F.col("char_end") - F.col("char_start"))
    w = Window.partitionBy("chunk_id").orderBy("char_start").rowsBetween(Window.unboundedPreceding, -1)
    df = items.withColumn("new_start", (F.col("char_start") + F.coalesce(F.sum(grown).over(w), F.lit(0))).cast("int"))
    return df.withColumn("new_end", (F.col("new_start") + F.length("placeholder")).cast("int"))


def rebuilt(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """(chunk_id, text_redacted, n_items) of chunks (chunk_id, text_raw) under items that do not overlap
    and lie in their chunk: the pieces between them and their placeholders, joined in order."""
    per = items.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "placeholder"))).alias("s"))  # bounded by a chunk's length
    j = chunks.select("chunk_id", F.coalesce("text_raw", F.lit("")).alias("t")).join(per, "chunk_id", "left")
    starts = F.concat(F.array(F.lit(0)), F.transform("s", lambda x: x["char_end"]))
    ends = F.concat(F.transform("s", lambda x: x["char_start"]), F.array(F.length("t")))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: citations.cut(F.col("t"), x["a"], x["b"]))
    marks = F.concat(F.transform("s", lambda x: x["placeholder"]), F.array(F.lit("")))
    text = F.when(F.col("s").isNull(), F.col("t")).otherwise(F.array_join(F.zip_with(pieces, marks, lambda p, m: F.concat(p, m)), ""))
    return j.select("chunk_id", text.alias("text_redacted"), F.coalesce(F.size("s"), F.lit(0)).alias("n_items"))


def placeholder(original: Column, anonymous_id: Column, *kinds: Column) -> Column:
    """What stands for an original: phones are masked, others get their mapping's id."""
    phone = F.lit(False)
    for kind in kinds:
        phone = phone | F.coalesce(F.upper(kind).isin(*PHONES), F.lit(False))
    masked = persons.masked_phone(original)
    return F.when(phone & (masked != "") & (masked != original), masked).otherwise(anonymous_id)


def _inside(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items whose place lies in their chunk's text, with the text as `_t`."""
    j = items.join(chunks.select("chunk_id", F.col("text_raw").alias("_t")), "chunk_id")
    return j.where((F.col("char_start") >= 0) & (F.col("char_start") < F.col("char_end")) & (F.col("char_end") <= F.length("_t")))


def additions_found(chunks: DataFrame, additions: DataFrame, items: DataFrame) -> DataFrame:
    """(fingerprint, chunk_id, char_start, char_end): where additions (rank, original, fingerprint) stand in
    chunks free of ledger rows. Originals are looked up by their rarest gram; the places found are
    anti-joined with the ledger's; of additions that overlap each other the one of the lower rank
    holds the place, of one original's own the earlier."""
    texts = chunks.select(F.col("chunk_id").alias("text_id"), F.col("text_raw").alias("text"))
    a = additions.where("original <> ''").groupBy("fingerprint").agg(F.min("rank").alias("rank"), F.first("original").alias("original"))
    a = storage.cut(a)
    met = search.held(a.select(F.col("fingerprint").alias("pattern_id"), F.col("original").alias("pattern")), texts, carry=("text",))
    j = met.join(a.withColumnRenamed("fingerprint", "pattern_id"), "pattern_id")
    at = j.select("rank", F.col("pattern_id").alias("fingerprint"), F.col("text_id").alias("chunk_id"), F.explode(citations.occurrences(F.col("text"), F.col("original"))).alias("char_start"), F.length("original").alias("n"))
    at = at.select("rank", "fingerprint", "chunk_id", F.col("char_start").cast("int"), (F.col("char_start") + F.col("n")).cast("int").alias("char_end"))
    at = storage.cut(at.withColumn("span_id", F.concat_ws(":", "chunk_id", "rank", "char_start")))
    taken = live.overlapping(at, items.select("chunk_id", F.col("item_id").alias("other_id"), "char_start", "char_end"))
    free = at.join(taken.select("span_id").distinct(), "span_id", "left_anti")
    # in order of rank and place, each against those that hold a place already; bounded by a chunk's length
    per = free.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("rank", "char_start", "char_end", "fingerprint"))).alias("s"))
    clear = lambda kept, x: ~F.exists(kept, lambda y: (y["char_start"] < x["char_end"]) & (y["char_end"] > x["char_start"]))
    kept = F.aggregate("s", F.filter("s", lambda x: F.lit(False)), lambda acc, x: F.when(clear(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return per.select("chunk_id", F.explode(kept).alias("x")).select("x.fingerprint", "chunk_id", "x.char_start", "x.char_end")


def batch(chunks: DataFrame, items: DataFrame, mappings: DataFrame, deletions: DataFrame, updates: DataFrame, additions: DataFrame, salt: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One batch: (rebuilt chunks, their ledger rows with places in the new text, all mappings).

    deletions: (fingerprint), their originals come back; updates: (fingerprint, anonymous_id,
    sens_type), null leaves a value as it is; additions: (rank, original, sens_type), a known
    original keeps its mapping. A row whose mapping is gone is dropped, a row out of its chunk too."""
    d = deletions.select("fingerprint").distinct()
    u = updates.select("fingerprint", F.col("anonymous_id").alias("_id"), F.col("sens_type").alias("_sens"))
    m = mappings.join(u, "fingerprint", "left").select("fingerprint", F.coalesce("_id", "anonymous_id").alias("anonymous_id"), F.coalesce("_sens", "sens_type").alias("sens_type"))
    add = additions.where("original <> '' and sens_type <> ''").select("rank", "original", "sens_type", ledger.fingerprint(F.col("original"), salt).alias("fingerprint"))
    new = add.groupBy("fingerprint").agg(F.min_by("sens_type", "rank").alias("sens_type")).join(m, "fingerprint", "left_anti")
    m = storage.cut(m.unionByName(new.select("fingerprint", F.concat_ws("_", "sens_type", F.left("fingerprint", F.lit(8))).alias("anonymous_id"), "sens_type")))
    live_m = m.join(d, "fingerprint", "left_anti")
    # rows that stay, with placeholders anew where their mapping was updated
    touched = items.join(d.unionByName(u.select("fingerprint")).distinct().withColumnRenamed("fingerprint", "map_ref"), "map_ref", "left_semi").select("chunk_id")
    kept = _inside(items.join(d.withColumnRenamed("fingerprint", "map_ref"), "map_ref", "left_anti"), chunks)
    again = kept.join(u.select(F.col("fingerprint").alias("map_ref")).distinct().withColumn("_again", F.lit(True)), "map_ref", "left")
    named = live_m.select(F.col("fingerprint").alias("map_ref"), "anonymous_id", F.col("sens_type").alias("_kind"))
    again = again.join(named, "map_ref", "left")
    raw = citations.cut(F.col("_t"), F.col("char_start"), F.col("char_end"))
    fresh = F.when(F.col("_again"), F.when(F.col("anonymous_id").isNotNull(), placeholder(raw, F.col("anonymous_id"), F.col("sens_type"), F.col("_kind")))).otherwise(F.col("placeholder"))
    kept = again.withColumn("placeholder", fresh).where("placeholder is not null").select(*ITEM)
    kept = storage.cut(kept)
    found = additions_found(chunks, add, kept).join(live_m, "fingerprint")
    found = _inside(found, chunks).select(F.concat_ws(":", F.lit("add"), "chunk_id", "char_start").alias("item_id"), "chunk_id", "char_start", "char_end", placeholder(raw, F.col("anonymous_id"), F.col("sens_type")).alias("placeholder"), F.col("fingerprint").alias("map_ref"), "sens_type")
    found = storage.cut(found)
    touched = touched.unionByName(found.select("chunk_id")).distinct()
    rows = kept.join(touched, "chunk_id", "left_semi").unionByName(found)
    return rebuilt(chunks.join(touched, "chunk_id", "left_semi"), rows), placed(rows), live_m


def repaired(chunks: DataFrame, items: DataFrame, mappings: DataFrame, salt: str, surnames: str = persons.SURNAMES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Person spans of the ledger repaired: (rebuilt chunks, their rows with places, mappings).

    A span that is no name goes; one that shrinks is taken; one that grows is taken unless it meets another
    row of its chunk as that was stored. A changed span refers to the mapping of its new surface,
    made if there is none, and mappings that no row refers to any more go."""
    chunks = chunks.hint("merge")  # texts are never broadcast, whatever the planner takes their size for
    own = _inside(items.where(F.col("sens_type").isin(*PERSONS)), chunks)
    places = spans.extended(own.select("item_id", F.col("_t").alias("text"), "char_start", "char_end"), surnames)
    j = storage.cut(own.join(places, "item_id"))
    surface = citations.cut(F.col("_t"), F.col("to_start"), F.col("to_end"))
    j = j.withColumn("surface", surface).withColumn("ok", (F.length("surface") >= 2) & F.coalesce(persons.person_ok(F.col("surface")), F.lit(False)))
    dropped = j.where("not ok").select("item_id", "chunk_id")
    moved = j.where("ok and (to_start <> char_start or to_end <> char_end)")
    grows = moved.where("to_end - to_start >= char_end - char_start")
    others = items.join(dropped.select("item_id"), "item_id", "left_anti")
    over = live.overlapping(grows.select("chunk_id", F.col("item_id").alias("span_id"), F.col("to_start").alias("char_start"), F.col("to_end").alias("char_end")), others.select("chunk_id", F.col("item_id").alias("other_id"), "char_start", "char_end"))
    met = over.where("span_id <> other_id").select(F.col("span_id").alias("item_id")).distinct()
    moved = moved.join(met, "item_id", "left_anti").withColumn("map_to", ledger.fingerprint(F.col("surface"), salt))
    moved = storage.cut(_apart(moved))
    new = moved.groupBy("map_to").agg(F.min("sens_type").alias("sens_type")).withColumnRenamed("map_to", "fingerprint").join(mappings, "fingerprint", "left_anti")
    m = mappings.select("fingerprint", "anonymous_id", "sens_type").unionByName(new.select("fingerprint", F.concat_ws("_", "sens_type", F.left("fingerprint", F.lit(8))).alias("anonymous_id"), "sens_type"))
    named = m.select(F.col("fingerprint").alias("map_to"), F.col("anonymous_id").alias("to_id"), F.col("sens_type").alias("to_sens"))
    to = moved.select("item_id", "to_start", "to_end", "map_to").join(named, "map_to")
    rows = items.select(*ITEM).join(dropped.select("item_id"), "item_id", "left_anti").join(to, "item_id", "left")
    rows = storage.cut(rows.select("item_id", "chunk_id", F.coalesce("to_start", "char_start").alias("char_start"), F.coalesce("to_end", "char_end").alias("char_end"), F.coalesce("to_id", "placeholder").alias("placeholder"), F.coalesce("map_to", "map_ref").alias("map_ref"), F.coalesce("to_sens", "sens_type").alias("sens_type")))
    touched = dropped.select("chunk_id").unionByName(moved.select("chunk_id")).distinct()
    inside = _inside(rows.join(touched, "chunk_id", "left_semi"), chunks).select(*ITEM)
    used = live.orphans(m, rows.withColumnRenamed("map_ref", "fingerprint"), "fingerprint").select("fingerprint")
    return rebuilt(chunks.join(touched, "chunk_id", "left_semi"), inside), placed(inside), m.join(used, "fingerprint", "left_anti")


def _apart(moved: DataFrame) -> DataFrame:
    """Of changed spans of a chunk that would come to overlap each other, the earlier stays."""
    per = moved.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("to_start", "to_end", "item_id"))).alias("s"))
    kept = F.aggregate("s", F.filter("s", lambda x: F.lit(False)), lambda acc, x: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["to_end"] <= x["to_start"]), F.concat(acc, F.array(x))).otherwise(acc))
    ids = per.select(F.explode(F.transform(kept, lambda x: x["item_id"])).alias("item_id"))
    return moved.join(ids, "item_id", "left_semi")
