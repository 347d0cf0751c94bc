"""Chat formatting by schema fingerprinting, in DataFrame operations alone.

A record is JSON of some layout. Its nested field paths (keys of the object, and of the objects in its arrays) that any
mapping speaks of, sorted, are hashed; other keys (names, ids, dates) do not matter. The hash selects a declarative
mapping, which says where roles and texts lie, and the mapping's expression turns the record into canonical turns.
Optional fields may be missing; an input follows its instruction after a blank line; a content that is a list of parts is
the text of its parts. The template writes a turn as [role]text</s>. Within roles and texts the characters ~ < [ ] are
written ~0 ~1 ~2 ~3, so no text can hold a marker, and reading back is exact. The loss mask is the list of code-point
spans of assistant texts in the formatted string.

Null roles and texts are empty. A record without a mapping has null turns and layout, keeps its schema_hash, and says in
problem why: "no object" or "no mapping". An empty list of messages gives no turns and an empty string. Rows of one
conversation are sorted by turn, then role, then text; rows that are equal stay apart. Very long texts are one string in
memory, as in any Spark row. An empty table gives an empty one. A conversation is one row by nature, so one
conversation's turns meet in one task; nothing else does. canonical() and formatted() keep other columns; layout,
problem, schema_hash, turns, formatted and loss_mask replace columns of these names. digests() reads only its four columns.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, unused

#: Layouts: where the turns come from: a list with its role and text fields, or a role and the fields of its text for each
#: turn; optional: fields that may be missing.
LAYOUTS = {
    "messages": {"list": "messages", "role": "role", "text": "content", "optional": ["system"]},
    "shares": {"list": "conversations", "role": "from", "text": "value", "optional": ["system"]},
    "prompt": {"turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])], "optional": ["system"]},
    "completion": {"turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])], "optional": ["system"]},
    "instruction": {"turns": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])], "optional": ["system", "input"]},
    "instruction response": {"turns": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["response"])], "optional": ["system", "input"]},
    "question": {"turns": [("system", ["system"]), ("user", ["question"]), ("assistant", ["answer"])], "optional": ["system"]},
}
TURNS = "array<struct<role:string,text:string>>"
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3"))
END = "</s>"


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def field_paths(record: Column) -> Column:
    """Sorted, distinct paths: top-level keys, and key[].inner for arrays of objects; a string that looks like one is none.

    Where Spark makes no variant of the record (a nested key twice, more than its size limit) only the look decides.
    """
    top = F.from_json(record, "map<string,string>")
    kinds = F.from_json(record, "map<string,variant>")
    inner = F.flatten(
        F.transform(
            F.map_entries(top),
            lambda e: F.when(
                e["value"].startswith("[") & (_empty(F.schema_of_variant(kinds[e["key"]])) != "STRING"),
                F.transform(
                    F.array_distinct(F.flatten(F.transform(F.coalesce(F.from_json(e["value"], "array<map<string,string>>"), F.array()), lambda m: F.map_keys(m)))),
                    lambda k: F.concat(e["key"], F.lit("[]."), k),
                ),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    return F.array_sort(F.array_distinct(F.concat(F.map_keys(top), inner)))


def fingerprint(paths: Column) -> Column:
    return F.sha2(F.array_join(paths, "\n"), 256)


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _fields(how: dict) -> list[str]:
    """The paths of a layout, optional ones last."""
    told = [how["list"], f"{how['list']}[].{how['role']}", f"{how['list']}[].{how['text']}"] if "list" in how else [p for _, fields in how["turns"] for p in fields]
    return [p for p in told if p not in how["optional"]] + how["optional"]


#: All paths that some mapping speaks of.
KNOWN = sorted({p for how in LAYOUTS.values() for p in _fields(how)})


def _parts(raw: Column, kind: Column) -> Column:
    """The text of a content: itself, or that of its parts if it is a list (kind: its variant's schema)."""
    objects = F.transform(F.from_json(raw, "array<struct<text:string>>"), lambda p: p["text"])
    return F.when(kind.startswith("ARRAY<STRING"), F.array_join(F.from_json(raw, "array<string>"), "")).when(kind.startswith("ARRAY<OBJECT"), F.array_join(objects, "")).otherwise(_empty(raw))


def _listed(record: Column, how: dict) -> Column:
    shape = f"struct<`{how['list']}`:array<struct<`{how['role']}`:string,`{how['text']}`:string>>>"
    entries = F.try_variant_get(F.try_parse_json(record), f"$.{how['list']}", "array<variant>")

    def turn(m, i):
        kind = _empty(F.schema_of_variant(F.try_variant_get(F.get(entries, i), f"$.{how['text']}", "variant")))
        return F.struct(_empty(m[how["role"]]).alias("role"), _parts(m[how["text"]], kind).alias("text"))

    return F.transform(F.from_json(record, shape)[how["list"]], turn)


def _mappings(record: Column):
    """(layout, the hash that selects it, the turns) for each layout and choice of its optional fields."""
    for name, how in LAYOUTS.items():
        for n in range(len(how["optional"]) + 1):
            for some in combinations(how["optional"], n):
                paths = [p for p in _fields(how) if p not in how["optional"] or p in some]
                got = lambda fields: F.from_json(record, "struct<" + ",".join(f"`{p}`:string" for p in fields) + ">")
                if "list" in how:
                    turns = _listed(record, how)
                    if "system" in some:
                        turns = F.concat(F.array(F.struct(F.lit("system").alias("role"), _empty(got(["system"])["system"]).alias("text"))), turns)
                    # a list without entries shows only its own key
                    yield name, fingerprint(F.array(*map(F.lit, sorted(p for p in paths if "[]" not in p)))), turns
                else:
                    known = [(role, [p for p in fields if p in paths]) for role, fields in how["turns"]]
                    held = got([p for _, fields in known for p in fields])
                    said = lambda fields: F.array_join(F.filter(F.array(_empty(held[fields[0]]), *[F.nullif(held[p], F.lit("")) for p in fields[1:]]), lambda t: t.isNotNull()), "\n\n")
                    turns = F.array(*[F.struct(F.lit(role).alias("role"), said(fields).alias("text")) for role, fields in known if fields])
                yield name, fingerprint(F.array(*map(F.lit, sorted(paths)))), turns


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds layout (null if unknown), problem, schema_hash (of all paths) and turns to records with a JSON column."""
    paths = field_paths(F.col(record))
    core = fingerprint(F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, KNOWN)))))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    spare = unused(records)
    named = records.withColumns({"schema_hash": fingerprint(paths), spare: core})
    for name, wanted, value in _mappings(F.col(record)):
        match = named[spare] == wanted
        layout, turns = F.when(match, F.lit(name)).otherwise(layout), F.when(match, value).otherwise(turns)
    problem = F.when(F.col("schema_hash").isNull(), "no object").when(F.col("layout").isNull(), "no mapping")
    return named.withColumn("layout", layout).withColumn("turns", turns.cast(TURNS)).withColumn("problem", problem).drop(spare)


def formatted(records: DataFrame) -> DataFrame:
    """Adds formatted (the template's string) and loss_mask (spans of assistant texts: start, length in code points)."""
    pieces = F.transform("turns", lambda t: F.struct(F.concat(F.lit("["), escape(t["role"]), F.lit("]")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("learn")))
    text = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        pieces,
        start,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return records.withColumns({"formatted": text, "loss_mask": spans})


def read_back(text: Column) -> Column:
    """The turns that a formatted string holds."""
    pieces = F.filter(F.split(text, END), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(2)), "]", 1)).alias("role"), unescape(F.substr(p, F.instr(p, F.lit("]")) + F.lit(1))).alias("text")))


def loss_text(text: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(text, s["start"] + 1, s["length"]))), "")


def records_of(rows: DataFrame) -> DataFrame:
    """Conversations as records of the layout that their shape allows: prompt and response, instruction, shares or messages."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    got = rows.groupBy("conv_id").agg(turns.alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    at = lambda k: F.get("t", F.lit(k))["text"]
    is_pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    is_three = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    record = (
        F.when(is_pair, F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response"))))
        .when(is_three, F.to_json(F.struct(at(0).alias("system"), at(1).alias("instruction"), at(2).alias("output"))))
        .when(F.size("t") % 2 == 0, F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("from"), x["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
    )
    return got.select("conv_id", record.alias("record"))


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, schema_hash: all read back from the formatted string."""
    out = formatted(canonical(records_of(rows))).select("conv_id", "schema_hash", "formatted", "loss_mask", read_back(F.col("formatted")).alias("back"))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("_said", said).withColumn("_loss", loss_text(F.col("formatted"), F.col("loss_mask")))
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2("_said", 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def query(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    trap = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(trap).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    return digests(rows.unionByName(more))


ORACLE = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (
  SELECT *, replace(replace(replace(replace(role, '~', '~0'), '<', '~1'), '[', '~2'), ']', '~3') AS er,
         replace(replace(replace(replace(text, '~', '~0'), '<', '~1'), '[', '~2'), ']', '~3') AS et FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(er) + length(et) + 6)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
"""
