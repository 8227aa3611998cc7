"""What a person is shown of stored payloads: pseudonyms as aliases, at any nesting depth.

Only pseudonyms leave their payloads, as rows (payload_id, token), and meet the aliases in joins; texts are
rewritten where they are, in one pass over the payloads. Of the payloads those that may hold a token are
shuffled, once. So neither the depth of a payload nor the number of aliases matters. Storage fields keep
what they hold.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identifiers as ids
from . import citations, mappings

# Fields that are not rewritten, and what stands for a pseudonym without alias.
STORAGE = ("quote", "quote_hash", "quote_storage", "chunk_id", "document_version_id", "document_id", "candidate_id", "case_id", "id", "artifact_id", "task_id", "fingerprint", "ref_key")
STANDS = (("(?:PERSON|NAME)", "脱敏人员"), ("PHONE", "脱敏手机号"), ("(?:ACCOUNT|BANK_CARD|CREDIT_CARD)", "脱敏账户"), ("(?:ORGANIZATION|ORG)", "脱敏组织"), ("(?:ID|DEVICE)", "脱敏标识"))
LEADS, ENDS = r"[、,，]\s*(?=脱敏)", "^[、,， ]+|[、,， ]+$"
MARKED = r"(?:_|\\u005[fF])(?:[a-f0-9]|\\u00[36])"  # what a JSON text holds if one of its strings holds a token
SHOWN_AS_IDENTIFIER = ("PHONE", "ACCOUNT", "ID_CARD", "DEVICE", "IP")


def without_pseudonyms(text: Column, kind: Column | None = None) -> Column:
    """A text with aliases in place, for display: what is left of pseudonyms gets its stand-in, marks
    before stand-ins go, identifiers are shown as such."""
    out = F.trim(F.coalesce(text, F.lit("")))
    for pattern, stand in STANDS:
        out = F.regexp_replace(out, f"(?i){pattern}_[a-f0-9]{{1,16}}", stand)
    out = F.regexp_replace(out, LEADS, "")
    bare = F.regexp_replace(out, ENDS, "")
    return bare if kind is None else F.when(kind.isin(*SHOWN_AS_IDENTIFIER), ids.public_surface(out, kind)).otherwise(bare)


def review_values(values: DataFrame, mapping: DataFrame, own: str | None = None) -> DataFrame:
    """Adds display to values (value_id, text, object_type). mapping: (anonymous_id, value); `own` as in
    mappings.rendered."""
    mine = F.lit(None).cast("string") if own is None else F.col(own)
    values = values.withColumn("_h", F.sha2("text", 256)).withColumn("_own", mine)
    texts = values.select("_h", "_own", "text").where("text is not null").distinct()
    shown = mappings.rendered(texts, mapping, "_h", own="_own").select(F.col("_h").alias("_h2"), F.col("_own").alias("_own2"), F.col("text").alias("_shown"))
    j = values.join(shown, (F.col("_h") == F.col("_h2")) & F.col("_own").eqNullSafe(F.col("_own2")), "left").drop("_h", "_own", "_h2", "_own2")
    return j.withColumn("display", without_pseudonyms(F.col("_shown"), F.col("object_type"))).drop("_shown")


def _strings(value, path=(), field=None):
    """(path, text) of strings that are rewritten; the path of an object stands for its quote."""
    if isinstance(value, dict):
        quote = value.get("quote")
        if isinstance(quote, str) and quote.strip():
            yield path, value.get("quote_display") or quote
        for k, v in value.items():
            yield from _strings(v, (*path, k), k)
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from _strings(v, (*path, k), field)
    elif isinstance(value, str) and field not in STORAGE and _PSEUDONYM.search(value):
        yield path, value


_PSEUDONYM = re.compile(citations.PLACEHOLDER)


def _filled(payload, changes: list[tuple[list, str]]):
    """The payload with texts at their paths."""
    for path, text in sorted(changes, key=lambda x: -len(x[0])):
        at = payload
        for k in path[:-1]:
            at = at[k]
        own = at[path[-1]] if path else payload
        if not isinstance(own, dict):
            if path:
                at[path[-1]] = text
            else:
                payload = text
            continue
        kept = own.get("quote_storage")
        if _PSEUDONYM.search(own["quote"]) or not (isinstance(kept, str) and kept.strip()):
            own["quote_storage"] = own["quote"]
        own["quote"] = own["quote_display"] = text
    return payload


def _parsed(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


# without_pseudonyms and mappings.rendered for use inside the pass; Java's classes are those of ASCII, and its $
# stands before any last line end.
_STANDS = [(re.compile(f"(?ai){pattern}_[a-f0-9]{{1,16}}"), stand) for pattern, stand in STANDS]
_LEADS, _ENDS = re.compile(f"(?a){LEADS}"), re.compile(ENDS.replace("$", r"(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)"))
_TOKEN = re.compile(mappings.TOKEN)


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text) if "_" in text else []


def _replaced(text: str, token: str, to: str) -> str:
    """The text with `to` for the token where no further digit follows."""
    parts, at, k = [], 0, text.find(token)
    while k >= 0:
        end = k + len(token)
        if text[end : end + 1] and text[end] in "0123456789abcdef":
            k = text.find(token, k + 1)
            continue
        parts += (text[at:k], to)
        at, k = end, text.find(token, end)
    return "".join([*parts, text[at:]])


def _display(text: str, values=()) -> str:
    """What without_pseudonyms shows of a text; values: its tokens' (token, to), in the order in which they go."""
    if values:
        own = set(_tokens(text))
        for token, to in values:
            if token in own:
                text = _replaced(text, token, to)
    text = text.strip(" ")
    if "_" in text:
        for pattern, stand in _STANDS:
            text = pattern.sub(stand, text)
    return _ENDS.sub("", _LEADS.sub("", text) if "脱敏" in text else text)


def hydrated(payloads: DataFrame, mapping: DataFrame, key: str = "payload_id", payload: str = "payload", own: str | None = None) -> DataFrame:
    """Payloads (JSON texts) as they are shown. An object's quote moves to quote_storage and is shown with
    aliases; other strings that hold a pseudonym are shown so too. What is no JSON stays as it is.
    `own`: a column with the alias that a payload means where a pseudonym has several."""
    names = payloads.columns
    every = payloads.withColumn("__own", F.lit(None).cast("string") if own is None else F.col(own))

    def dealt(batches, with_tokens=True):  # a filter in SQL would make each payload once more
        for rb in batches:
            held = pc.fill_null(pc.match_substring_regex(rb.column(payload), MARKED), False)
            yield rb.filter(held if with_tokens else pc.invert(held))

    def opened(batches):
        for rb in dealt(batches):
            at, tokens = [], []
            for k, t in enumerate(rb.column(payload).to_pylist()):
                held = sorted({x for _, text in _strings(_parsed(t)) for x in _tokens(text)})
                at += [k] * len(held)
                tokens += held
            place = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([rb.column(key).take(place), rb.column("__own").take(place), pa.array(tokens, pa.string())], names=["__k", "__o", "token"])

    found = every.select(key, "__own", payload).mapInArrow(opened, T.StructType([T.StructField("__k", payloads.schema[key].dataType), *T.StructType.fromDDL("__o string, token string").fields]))
    each = F.struct(F.length("token").alias("n"), "token", F.col("to").eqNullSafe(F.col("__o")).alias("mine"), "to")
    per = mappings.valued(found, mapping).groupBy("__k", "__o").agg(F.collect_set(each).alias("__t"))  # a payload's own tokens
    per = per.withColumn("__t", F.transform(F.reverse(F.array_sort("__t")), lambda x: F.struct(x["token"].alias("token"), x["to"].alias("to"))))
    j = every.mapInArrow(dealt, every.schema).join(per, F.col(key).eqNullSafe(F.col("__k")) & F.col("__own").eqNullSafe(F.col("__o")), "left")

    def closed(batches):
        for rb in batches:
            out, held = [], rb.column("__t").to_pylist() if "__t" in rb.schema.names else [None] * rb.num_rows
            for t, values in zip(rb.column(payload).to_pylist(), held, strict=True):
                parsed = _parsed(t)
                values = [(x["token"], x["to"]) for x in values or ()]
                changes = [(path, _display(text, values)) for path, text in _strings(parsed)]
                out.append(json.dumps(_filled(parsed, changes), ensure_ascii=False, separators=(",", ":")) if changes else t)
            yield rb.select(names).set_column(names.index(payload), payload, pa.array(out, pa.string()))

    rest = every.mapInArrow(lambda batches: closed(dealt(batches, False)), payloads.schema)
    return j.select(*names, "__t").mapInArrow(closed, payloads.schema).unionByName(rest)
