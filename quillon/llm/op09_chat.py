"""Chat formatting by schema fingerprints, all in DataFrame functions.

Each record has any layout. The nested paths of its fields, without the types of leaves, are
hashed to a fingerprint, which selects a declarative mapping; a mapping says where the turns are,
or which fields become which turns. A record whose fingerprint is not declared (say, for
additional fields) takes the first mapping whose required fields it has.

Records come as JSON (`from_json_records`) or are built from rows by turn (`dealt`), which lays
conversations out in all declared layouts, as far as a layout can hold them. Texts never pass
through a variant, whose size is bounded: shapes are read from a skeleton of the JSON with its
strings emptied and equal neighbours of lists folded, so a record may be as large as a string.

The template is `<s>[role]` ROLE `[text]` TEXT `</s>` for each turn. Inside ROLE and TEXT `~`,
`<` and `[` are written `~0`, `~1` and `~2`, so no control string can occur there, and it is
undone exactly. The loss mask is a list of spans of the formatted string, the text of assistant
turns, each with the number of its turn.

Null texts and roles are empty, null turn numbers come first, equal turn numbers go by role and
text, and rows repeated in full stay. A record that is no JSON, or that no mapping fits, gives null
turns and says so in `error`; a null record gives null turns. An empty table gives none. Other
columns are kept by `from_json_records` and ignored by `dealt`; working columns are one struct,
`__q`, and columns of the results' names are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

OPEN, BODY, CLOSE = "<s>[role]", "[text]", "</s>"
PROBE = "</s>[INST] ok [/INST]"
PROBE_ID = -7

# Layouts of public chat and instruction data sets.
# name: (path of the list, role key, text key), or fields that each become a turn
LISTS = {
    "messages": ("messages", "role", "content"),
    "sharegpt": ("conversations", "from", "value"),
    "turns": ("turns", "role", "text"),
}
FIELDS = {
    "instruction": (("instruction", "input"), ("output",)),
    "instruction_response": (("instruction", "context"), ("response",)),
    "instruction_plain": (("instruction",), ("output",)),
    "prompt": (("prompt",), ("completion",)),
    "prompt_response": (("prompt",), ("response",)),
    "question": (("question",), ("answer",)),
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))


def _plain(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
SCHEMA = (
    "struct<" + ", ".join([f"{path}: array<struct<`{role}`: string, `{text}`: string>>" for path, role, text in LISTS.values()] + [f"{f}: string" for f in sorted({"system", *(f for ask, say in FIELDS.values() for f in (*ask, *say))})]) + ">"
)


def skeleton(c: Column) -> Column:
    """JSON with empty strings and zeros for values, and equal neighbours in lists once."""
    s = F.regexp_replace(c, f"({_STRING}\\s*+:)|{_STRING}", "$1\u0001")  # a mark behind each key and for each string
    s = F.replace(F.replace(s, F.lit("\u0001\u0001"), F.lit('""')), F.lit(":\u0001"), F.lit(":"))
    s = F.regexp_replace(F.regexp_replace(s, "\u0001", '""'), r":\s*+-?\d[\d.eE+-]*+", ":0")
    return F.regexp_replace(s, r"(\{[^{}\[\]]*+\})(?:\s*+,\s*+\1)++", "$1")


def _shape(c: Column) -> Column:
    """A variant's nested field paths, without the types of its leaves."""
    return F.regexp_replace(F.schema_of_variant(c), r"\b(STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DECIMAL\(\d+,\d+\))", "_")


def shape_of(fields: dict[str, str]) -> str:
    return "OBJECT<" + ", ".join(f"{f}: {t}" for f, t in sorted(fields.items())) + ">"


def sha(shape: str) -> str:
    return hashlib.sha256(shape.encode()).hexdigest()


def mappings() -> list[tuple[str, str]]:
    """(shape, layout) of every declared layout, with and without its optional fields."""
    out = []
    for name, (path, role, text) in LISTS.items():
        item = f"ARRAY<{shape_of({role: '_', text: '_'})}>"
        out += [(shape_of({path: item} | extra), name) for extra in ({}, {"id": "_"}, {"conv_id": "_"})]
    for name, (ask, say) in FIELDS.items():
        fields = dict.fromkeys([*ask, *say], "_")
        out += [(shape_of(fields | extra), name) for extra in ({}, {"id": "_"}, {"system": "_"}, {"conv_id": "_"})]
    return out


def from_json_records(records: DataFrame, column: str = "record") -> DataFrame:
    """Adds fingerprint, layout, error and turns: array<struct<role, text>> to records of JSON."""
    parsed_ = F.from_json(F.col(column), SCHEMA, {"maxStringLen": str(2**31 - 1)})
    shape = _shape(F.try_parse_json(skeleton(F.col(column))))
    df = canonical(records.withColumn("__q", F.struct(shape.alias("shape"), parsed_.alias("record"))))
    why = F.when(F.col(column).isNotNull() & F.col("fingerprint").isNull(), "not JSON").when(F.col(column).isNotNull() & F.col("layout").isNull(), "no mapping")
    return df.withColumn("error", why)


def canonical(records: DataFrame) -> DataFrame:
    """Adds fingerprint, layout and turns to records in `__q`: struct<shape, record: SCHEMA>."""
    df = records.withColumn("fingerprint", F.sha2(F.col("__q.shape"), 256))
    shapes, names = zip(*mappings(), strict=True)
    table = F.map_from_arrays(F.array(*(F.lit(sha(s)) for s in shapes)), F.array(*map(F.lit, names)))
    field = lambda name: F.col(f"__q.record.{name}")
    later = [F.when(field(p).isNotNull(), F.lit(n)) for n, (p, _, _) in LISTS.items()]
    for n, (ask, say) in FIELDS.items():
        later.append(F.when(field(ask[0]).isNotNull() & field(say[0]).isNotNull(), F.lit(n)))
    df = df.withColumn("layout", F.coalesce(F.try_element_at(table, F.col("fingerprint")), *later))
    role_of = F.map_from_arrays(F.array(*map(F.lit, ROLES)), F.array(*map(F.lit, ROLES.values())))

    def turn(role: Column, body: Column) -> Column:
        role = F.coalesce(role, F.lit(""))
        return F.struct(F.coalesce(F.try_element_at(role_of, F.lower(role)), role).alias("role"), F.coalesce(body, F.lit("")).alias("text"))

    def each(role: str, body: str):
        return lambda x: turn(x[role], x[body])

    cases = None
    for n, (path, role, body) in LISTS.items():
        turns = F.transform(field(path), each(role, body))
        cases = F.when(F.col("layout") == n, turns) if cases is None else cases.when(F.col("layout") == n, turns)
    system = F.when(F.length(field("system")) > 0, F.array(turn(F.lit("system"), field("system")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    for n, (ask, say) in FIELDS.items():
        asked = F.concat_ws("\n\n", *(F.when(F.length(field(a)) > 0, field(a)) for a in ask))
        cases = cases.when(F.col("layout") == n, F.concat(system, F.array(turn(F.lit("user"), asked), turn(F.lit("assistant"), field(say[0])))))
    return df.withColumn("turns", cases).drop("__q")


def formatted(turns: DataFrame) -> DataFrame:
    """Adds formatted: string and loss: array<struct<start, length, turn>> (code points, from 0)."""
    df = turns.withColumn("__q", F.transform("turns", lambda x: F.struct(_escaped(x["role"]).alias("r"), _escaped(x["text"]).alias("e"), (x["role"] == "assistant").alias("a"))))
    sizes = F.transform("__q", lambda x: F.struct((F.length(x["r"]) + len(OPEN + BODY)).cast("long").alias("h"), F.length(x["e"]).cast("long").alias("t"), x["a"].alias("a")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("k"), F.array().cast("array<struct<start:bigint,length:bigint,turn:int>>").alias("spans"))
    spans = F.aggregate(
        sizes,
        zero,
        lambda acc, x: F.struct(
            (acc["at"] + x["h"] + x["t"] + len(CLOSE)).alias("at"),
            (acc["k"] + 1).alias("k"),
            F.when(x["a"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["h"]).alias("start"), x["t"].alias("length"), acc["k"].alias("turn"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    whole = F.array_join(F.transform("__q", lambda x: F.concat(F.lit(OPEN), x["r"], F.lit(BODY), x["e"], F.lit(CLOSE))), "")
    return df.withColumn("formatted", whole).withColumn("loss", spans).drop("__q")


def segments(c: Column) -> Column:
    """The formatted string's turns, as they stand, without their opening."""
    parts = F.split(c, r"<s>\[role\]")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def parsed(c: Column) -> Column:
    """The turns of a formatted string."""
    body = lambda s: F.split(s, r"\[text\]", 2)
    cut = lambda t: F.substr(t, F.lit(1), F.length(t) - len(CLOSE))
    return F.transform(F.transform(segments(c), body), lambda p: F.struct(_plain(p[0]).alias("role"), _plain(cut(p[1])).alias("text")))


def masked(text: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, in order. A span is taken from its turn's segment,
    at its start less the segments before, so the string is passed once."""
    parts = segments(text)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate(F.transform(parts, lambda s: F.length(s).cast("long")), zero, lambda acc, n: F.struct((acc["at"] + len(OPEN) + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + len(OPEN))).alias("starts")), lambda acc: acc["starts"])
    both = F.array(F.struct(parts.alias("p"), starts.alias("s")))
    read = lambda x: F.transform(spans, lambda z: _plain(F.substr(F.get(x["p"], z["turn"]), (z["start"] - F.get(x["s"], z["turn"]) + 1).cast("int"), z["length"].cast("int"))))
    return F.array_join(F.get(F.transform(both, read), 0), "")


def dealt(rows: DataFrame) -> DataFrame:
    """(conv_id, __q) of rows by turn (conv_id, turn, role, text): each conversation in one of the
    layouts that can hold it, by a hash of its id."""
    item = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    df = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("m"))
    roles = F.transform("m", lambda x: x["role"])
    is_ = lambda *names: roles == F.array(*map(F.lit, names))
    led = is_("system", "user", "assistant") & (F.length(F.get("m", 0)["text"]) > 0)
    known = F.forall("m", lambda x: x["role"].isin("system", "user", "assistant"))
    lists, fields = list(LISTS), list(FIELDS)
    k = F.pmod(F.xxhash64("conv_id"), F.lit(60)).cast("int")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i)
    layout = F.when((is_("user", "assistant") | led) & (k < 40), pick(fields, k % len(fields))).when(known, pick(lists, k % len(lists))).otherwise(pick([n for n in lists if n != "sharegpt"], k % (len(lists) - 1)))
    df = df.withColumn("l", layout).withColumn("led", led)
    named = {"user": "human", "assistant": "gpt"}

    def items(n: str, role: str, text: str):
        def of(x):
            own = F.when(x["role"] == "user", named["user"]).when(x["role"] == "assistant", named["assistant"]).otherwise(x["role"]) if n == "sharegpt" else x["role"]
            return F.struct(own.alias(role), x["text"].alias(text))

        return of

    cols, shapes = [], []
    for n, (path, role, text) in LISTS.items():
        cols.append(F.when(F.col("l") == n, F.transform("m", items(n, role, text))).alias(path))
        shapes.append((n, F.lit(shape_of({path: f"ARRAY<{shape_of({role: '_', text: '_'})}>"}))))
    asked, said = F.element_at("m", -2)["text"], F.element_at("m", -1)["text"]
    for f in sorted({"system", *(f for ask, say in FIELDS.values() for f in (*ask, *say))}):
        value = F.lit(None).cast("string")
        for n, (ask, say) in FIELDS.items():
            own = asked if f == ask[0] else F.lit("") if f in ask else said if f == say[0] else F.when(F.col("led"), F.get("m", 0)["text"]) if f == "system" else None
            if own is not None:
                value = F.when(F.col("l") == n, own).otherwise(value)
        cols.append(value.alias(f))
    for n, (ask, say) in FIELDS.items():
        plain = dict.fromkeys([*ask, *say], "_")
        shapes.append((n, F.when(F.col("led"), shape_of(plain | {"system": "_"})).otherwise(shape_of(plain))))
    shape = F.coalesce(*(F.when(F.col("l") == n, s) for n, s in shapes))
    return df.select("conv_id", F.struct(shape.alias("shape"), F.struct(*cols).alias("record")).alias("__q"))


def digest(df: DataFrame) -> DataFrame:
    back = df.withColumn("_t", parsed(F.col("formatted"))).withColumn("_l", masked(F.col("formatted"), F.col("loss")))
    all_turns = F.array_join(F.transform("_t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("_t").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("_l").cast("long").alias("loss_chars"),
        F.sha2("_l", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("int"), F.col("role").cast("string"), F.col("text").cast("string"))
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digest(formatted(canonical(dealt(rows.union(probe)))))


SQL = f"""
WITH r AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN + BODY + CLOSE)} + 2 * (length(role) + length(text)) - length(regexp_replace(role, '[~<\\[]', '', 'g')) - length(regexp_replace(text, '[~<\\[]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
