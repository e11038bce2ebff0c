"""Chat formatting by schema fingerprints.

A record is a JSON object in some layout: one turn a record, a list of messages, an instruction with its output, a
prompt with its completion. The nested field paths of each record, with types left out, are hashed to a fingerprint;
the fingerprint selects a declarative mapping (LAYOUTS), and the mapping says where role and text are. A record whose
fingerprint no layout has is looked at without the fields that no layout knows (a list counts by its first item): of the
layouts all of whose fields it has, that with the most fields is taken, of equally large ones the first. The canonical turns of a conversation are then written in one template that marks turns, escapes its own control strings inside
roles and texts, and comes with a loss mask over the assistant's texts. Everything is SQL expressions: the fingerprint
comes from Spark's VARIANT type, and one exchange by conversation brings its turns together.

Defined cases: null role or text counts as empty; null turn numbers come first; equal turn numbers are ordered by
role, then text; repeated rows are repeated turns. A record that lacks a field of every layout, is no JSON or is longer
than a VARIANT holds (128 MiB) gives one row with a null layout in canonical_turns and nothing in the formatted output. Other columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"
#: Roles as other layouts call them, and what they are here.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: name: (a sample record of the layout by its field paths, list of turns, role field, text field) or, where each turn has
#: a field of its own, (paths, None, [(role, field), ...]).
LAYOUTS = {
    "turn": ("OBJECT<conv_id, role, text, turn>", None, None),
    "messages": ("OBJECT<messages: ARRAY<OBJECT<content, role>>>", "$.messages", ("$.role", "$.content")),
    "conversations": ("OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "$.conversations", ("$.from", "$.value")),
    "instruction": ("OBJECT<input, instruction, output>", None, [("user", ("$.instruction", "$.input")), ("assistant", ("$.output",))]),
    "instruction_only": ("OBJECT<instruction, output>", None, [("user", ("$.instruction",)), ("assistant", ("$.output",))]),
    "prompt": ("OBJECT<completion, prompt>", None, [("user", ("$.prompt",)), ("assistant", ("$.completion",))]),
    "response": ("OBJECT<prompt, response>", None, [("user", ("$.prompt",)), ("assistant", ("$.response",))]),
}


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a VARIANT, whatever its values and their types."""
    return F.xxhash64(F.regexp_replace(F.schema_of_variant(record), r": (?!OBJECT|ARRAY)[A-Z]+(?:\([^)]*\))?", ""))


def fields_of(paths: str) -> list[str]:
    """The paths of a layout's fields that hold values, a list's by its first item."""
    found, prefix, name = [], [], ""
    for token in re.findall(r"OBJECT<|ARRAY<|>|[a-z_]+", paths):
        if token == "OBJECT<":
            prefix.append(f".{name}" if name else "")
            name = ""
        elif token == "ARRAY<":
            prefix.append(f".{name}[0]")
            name = ""
        elif token == ">":
            prefix.pop()
        else:
            name = token
            found.append("$" + "".join(prefix) + f".{token}")
    # a field that holds others is not one of its own
    return [p for p in found if not any(o.startswith((p + ".", p + "[")) for o in found)]


def has_fields(v: Column, paths: str) -> Column:
    """Whether a VARIANT has all fields of a layout, null ones too."""
    return reduce(and_, [F.try_variant_get(v, p, "variant").isNotNull() for p in fields_of(paths)])


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _message(fields: tuple[str, str], turn):
    return lambda x, i: turn(i, _text(x, fields[0]), _text(x, fields[1]))


def canonical_turns(records: DataFrame, id_col: str = "id", json_col: str = "json") -> DataFrame:
    """A row for each turn: conv_id, turn, part, role, text, layout. A record of no known layout gives a row with null layout and role."""
    v = F.col("v")
    df = records.select(F.col(id_col).alias("id"), F.try_parse_json(json_col).alias("v")).withColumn("f", fingerprint(v))
    none = F.lit(None)
    turn_type = "array<struct<turn:bigint,role:string,text:string>>"
    turn = lambda n, role, text: F.struct(n.cast("long").alias("turn"), role.cast("string").alias("role"), text.alias("text"))
    by_hash = none.cast("string")
    for name, (paths, _, _) in reversed(LAYOUTS.items()):
        by_hash = F.when(F.col("f") == F.xxhash64(F.lit(paths)), F.lit(name)).otherwise(by_hash)
    # larger layouts first; sorted() leaves equally large ones in order
    by_fields = F.coalesce(*[F.when(has_fields(v, LAYOUTS[name][0]), F.lit(name)) for name in sorted(LAYOUTS, key=lambda name: -len(fields_of(LAYOUTS[name][0])))])
    df = df.withColumn("layout", F.when(v.isNotNull(), F.coalesce(by_hash, by_fields)))
    turns = none.cast(turn_type)
    for name, (_, items, fields) in reversed(LAYOUTS.items()):
        if items:
            each = F.transform(F.try_variant_get(v, items, "array<variant>"), _message(fields, turn))
        elif fields:
            each = F.array(*[turn(F.lit(n), F.lit(role), F.concat_ws("\n", *[F.nullif(_text(v, p), F.lit("")) for p in texts])) for n, (role, texts) in enumerate(fields)])
        else:
            each = F.array(turn(F.try_variant_get(v, "$.turn", "bigint"), _text(v, "$.role"), _text(v, "$.text")))
        turns = F.when(F.col("layout") == name, each.cast(turn_type)).otherwise(turns)
    df = df.select("id", "layout", F.posexplode_outer(turns).alias("part", "t"))
    role = F.col("t.role")
    for theirs, ours in ROLES.items():
        role = F.when(F.col("t.role") == theirs, F.lit(ours)).otherwise(role)
    return df.select(F.col("id").alias("conv_id"), "t.turn", "part", role.alias("role"), "t.text", "layout")


def escape(text: Column) -> Column:
    """A backslash before each backslash and inside each control mark, so that neither mark is left."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(OPEN), F.lit("<\\|")), F.lit(CLOSE), F.lit("|\\>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, formatted, loss_spans (of each assistant text: its turn, where the turn's text starts in the turn, where it starts in formatted, its length)."""
    turns = turns.filter("layout is not null").select("conv_id", "turn", "part", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = Window.partitionBy("conv_id").orderBy("turn", "part", "role", "text")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE + "\n"))
    df = turns.select("conv_id", "turn", "part", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    df = df.withColumn("piece", F.concat("head", "body", F.lit(END)))
    df = df.withColumn("n", F.row_number().over(by)).withColumn("before", F.sum(F.length("piece").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.length("head")
    span = F.when(F.col("role") == "assistant", F.struct((F.col("n") - 1).alias("turn"), inside.alias("inside"), (F.coalesce("before", F.lit(0)) + inside).alias("start"), F.length("body").alias("length")))
    df = df.select("conv_id", F.struct("n", "piece", span.alias("span")).alias("t"))
    df = df.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    spans = F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull())
    return df.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def split_turns(formatted: Column) -> Column:
    """The turns of a formatted text, each without its end mark."""
    found = F.split(formatted, r"<\|end\|>\n")
    return F.slice(found, F.lit(1), F.size(found) - 1)


def read_turn(piece: Column) -> Column:
    """Role and text of a turn."""
    close = F.call_function("locate", F.lit(CLOSE), piece, F.lit(3))
    role = F.substring(piece, F.lit(3), close - 3)
    return F.struct(unescape(role).alias("role"), unescape(F.substring(piece, close + 3, F.length(piece))).alias("text"))


def from_rows(conversations: DataFrame) -> DataFrame:
    """A table with a row for each turn, as JSON records."""
    columns = ["conv_id", "role", "text", "turn"]
    return conversations.select(F.col("conv_id").alias("id"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))
