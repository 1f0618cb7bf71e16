r"""Chat formatting by schema fingerprints.

A record's nested field paths are hashed, row by row; the hash selects a declarative mapping that
turns the record's layout into canonical turns. The template writes a turn as

    ### role: text</turn>\n

and escapes the strings that steer it wherever they stand in a role or a text: a backslash is
written \b, the < of </turn> is written \l, the first # of "### " is written \h (in a role also
: as \c and a line feed as \n). Each escape is a backslash and a letter of its own, so reading
back is exact. All of it is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.llm.common import fresh

TURNS = "array<struct<role:string,text:string>>"
END, START = "</turn>\n", "### "

#: What records are made of: single texts that a user is asked with, in order, texts that answer, of which the first that is
#: there counts, and lists of messages with the fields for a role and a text, the first list and fields that are there.
USERS = ("context", "instruction", "prompt", "question", "query", "inputs", "input")
ANSWERS = ("completion", "response", "output", "answer", "targets", "chosen")
LISTS = ("messages", "conversations", "turns", "chosen", "data.messages")
ROLE_FIELDS, TEXT_FIELDS = ("role", "from", "speaker"), ("content", "value", "text")
#: Roles of lists that say from whom a message is, in any case.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPING = "fingerprint string, layout string, system boolean, users array<string>, list string, role_field string, text_field string, answer string"


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _name(users: tuple[str, ...], listed: str, answer: str) -> str:
    if listed:
        return {"chosen": "chosen_messages"}.get(listed, listed)
    asked = next(u for u in ("instruction", "question", "prompt", "query", "inputs", "input", "context") if u in users)
    return {"chosen": "chosen", "response": "response"}.get(answer, asked) if asked == "prompt" else asked


def mappings() -> list[tuple]:
    """Rows of MAPPING: what records of each set of paths become, by the set's fingerprint.

    Any one or two user texts, a list or an answer (or both) and a system text make a layout; texts that
    a list begins or ends with beside it stay.
    """
    asked = [u for n in range(3) for u in combinations(USERS, n)]
    lists = [("", "", "")] + [(at, r, t) for at in LISTS for r in ROLE_FIELDS for t in (*TEXT_FIELDS, "")]
    out = []
    for system in (False, True):
        for users in asked:
            for at, r, t in lists:
                for answer in ("", *ANSWERS):
                    if (at and at != answer) or (users and answer and not at):
                        paths = [*users, *(x for x in ("system" * system, answer) if x), *(f"{at}[].{f}" for f in (r, t) if at and f)]
                        out.append((fingerprint(paths), _name(users, at, answer), system, list(users), at, r, t, answer))
    return out


def _field(x: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(x, f"$.{path}", kind)


def _kind(x: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0), F.lit(""))


def known_paths(record: Column) -> Column:
    """The paths of a VARIANT record that a mapping reads, sorted; an array adds []."""
    single = lambda p: F.when(~_kind(_field(record, p)).isin("", "ARRAY", "OBJECT"), F.array(F.lit(p)))

    def inside(at: str, names: tuple[str, ...]) -> Column:
        items = _field(record, at, "array<variant>")
        has = lambda name: F.exists(items, lambda x: _field(x, name).isNotNull())
        return F.coalesce(*(F.when(has(n), F.array(F.lit(f"{at}[].{n}"))) for n in names))

    none = F.array().cast("array<string>")
    listed = F.coalesce(*(F.when(inside(at, ROLE_FIELDS).isNotNull(), F.concat(inside(at, ROLE_FIELDS), F.coalesce(inside(at, TEXT_FIELDS), none))) for at in LISTS), none)
    answer = F.coalesce(*(single(p) for p in ANSWERS), none)
    return F.array_sort(F.concat(listed, answer, *(F.coalesce(single(p), none) for p in ("system", *USERS))))


def all_paths(record: Column) -> Column:
    """The paths of a VARIANT record that have a value, sorted: two levels of objects and of lists of objects."""

    def keys(x: Column, before: Column) -> Column:
        fields = F.map_filter(F.try_variant_get(x, "$", "map<string,variant>"), lambda k, v: ~_kind(v).isin("", "VOID"))
        return F.coalesce(F.transform(F.map_entries(fields), lambda e: F.struct(F.concat(before, e["key"]).alias("path"), e["value"].alias("value"))), F.array().cast("array<struct<path:string,value:variant>>"))

    def deeper(e: Column) -> Column:
        of_items = F.flatten(F.transform(F.try_variant_get(e["value"], "$", "array<variant>"), lambda x: keys(x, F.concat(e["path"], F.lit("[].")))))
        found = F.when(_kind(e["value"]) == "OBJECT", keys(e["value"], F.concat(e["path"], F.lit(".")))).when(_kind(e["value"]) == "ARRAY", of_items)
        return F.when(F.size(F.coalesce(found, F.array())) > 0, found).otherwise(F.array(e))

    once = F.flatten(F.transform(keys(record, F.lit("")), deeper))
    twice = F.flatten(F.transform(once, deeper))
    return F.array_sort(F.array_distinct(F.transform(twice, lambda e: e["path"])))


def _turn(role: Column, said: Column) -> Column:
    return F.struct(role.alias("role"), said.alias("text"))


def _variant_text(x: Column, field: str) -> Column:
    """A field as text: a list of parts gives its texts, line by line, anything else itself; null is empty."""
    own = _field(x, field)
    parts = F.transform(F.try_variant_get(own, "$", "array<variant>"), lambda p: F.coalesce(_field(p, "text", "string"), F.lit("")))
    return F.coalesce(F.when(_kind(own) == "ARRAY", F.array_join(parts, "\n")).otherwise(F.try_variant_get(own, "$", "string")), F.lit(""))


def _mapped(record: Column, to: Column) -> Column:
    """The turns that a mapping (a struct of MAPPING) makes of a VARIANT record."""
    none = F.array().cast(TURNS)
    pick = lambda of, names, value: F.coalesce(*(F.when(of == n, value(n)) for n in names))
    listed = to["list"] != ""
    text = lambda path, names: pick(path, names, lambda n: _field(record, n, "string"))
    items = pick(to["list"], LISTS, lambda n: _field(record, n, "array<variant>"))
    known = F.create_map(*(F.lit(v) for pair in ROLE_NAMES.items() for v in pair))

    def message(x: Column) -> Column:
        role = pick(to["role_field"], ROLE_FIELDS, lambda n: _variant_text(x, n))
        said = F.coalesce(pick(to["text_field"], TEXT_FIELDS, lambda n: _variant_text(x, n)), F.lit(""))
        return _turn(F.when(to["role_field"] == "from", F.coalesce(known[F.lower(role)], role)).otherwise(role), said)

    messages = F.coalesce(F.when(listed, F.transform(items, message)), none)
    asked = F.array_compact(F.transform(to["users"], lambda p: text(p, USERS)))
    said = F.array_join(asked, "\n\n")
    first = F.get(F.filter(messages, lambda t: t["role"] == "user"), F.lit(0))["text"]
    # a list that begins with the prompt has it already
    again = F.coalesce(first == said, F.lit(False)) | (listed & (F.size(asked) == 0))
    user = F.when((F.size(to["users"]) > 0) & ~again, F.array(_turn(F.lit("user"), said)))
    system = F.when(to["system"] & _field(record, "system", "string").isNotNull(), F.array(_turn(F.lit("system"), _field(record, "system", "string"))))
    answered = text(to["answer"], ANSWERS)
    answer = F.when((to["answer"] != "") & (answered.isNotNull() | ~listed), F.array(_turn(F.lit("assistant"), F.coalesce(answered, F.lit("")))))
    return F.concat(F.coalesce(system.cast(TURNS), none), F.coalesce(user.cast(TURNS), none), messages.cast(TURNS), F.coalesce(answer.cast(TURNS), none))


def canonical_turns(df: DataFrame, record_col: str) -> DataFrame:
    """Adds layout, turns (array<struct<role, text>>), unread and unknown_layout, in place of columns of these names.

    JSON text, VARIANT and struct records may each have another layout: row by row, the nested paths that
    mappings know are hashed, and the mapping of that fingerprint, out of a table of some 25,000 that is
    broadcast, says what becomes of them: a system text, what a user is asked, a list of messages and an
    answer, in this order; a prompt that the list begins with isn't said twice. Null texts and roles
    become empty; a message without content keeps its turn, with an empty text; an optional field that
    is null gives no turn. unread are the paths with a value that the mapping leaves out. Where no
    mapping has the fingerprint, layout, turns and unread are null and unknown_layout is the
    record's schema (null too if it isn't JSON).
    """
    spark, kind, record = df.sparkSession, df.schema[record_col].dataType, F.col(record_col)
    table = spark.createDataFrame(mappings(), MAPPING)
    own, to = fresh(df, "_variant"), fresh(df, "_mapping")
    parsed = F.try_parse_json(record) if kind.typeName() == "string" else F.to_variant_object(record) if isinstance(kind, StructType) else record
    carried = df.drop("layout", "turns", "unread", "unknown_layout") if record_col not in ("layout", "turns", "unread", "unknown_layout") else df
    named = carried.withColumn(own, parsed)
    paths, variant, mapping = known_paths(F.col(own)), F.col(own), F.col(to)
    chosen = F.broadcast(table.select(F.struct(*table.columns).alias(to)))
    joined = named.join(chosen, F.sha2(F.array_join(paths, "\n"), 256) == mapping["fingerprint"], "left")
    there = mapping.isNotNull()
    lists = lambda field: F.when((mapping["list"] != "") & (mapping[field] != ""), F.array(F.concat(mapping["list"], F.lit("[]."), mapping[field]))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.coalesce(mapping["list"], F.lit("")), F.lit("[]."), F.coalesce(mapping["text_field"], F.lit("")), F.lit("[]."))
    read = F.concat(mapping["users"], F.array(mapping["answer"], F.when(mapping["system"], "system").otherwise("")), lists("role_field"), lists("text_field"))
    unread = F.filter(F.array_except(all_paths(variant), read), lambda p: ~F.startswith(p, parts))
    return joined.withColumns(
        {
            "layout": mapping["layout"],
            "turns": F.when(there, _mapped(variant, mapping)),
            "unread": F.when(there, unread),
            "unknown_layout": F.when(~there, F.schema_of_variant(variant)),
        }
    ).drop(own, to)


def _swap(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    return _swap(text, ("\\", "\\b"), ("</turn>", "\\l/turn>"), ("### ", "\\h## "))


def unescape(text: Column) -> Column:
    return _swap(text, ("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\n", "\n"), ("\\b", "\\"))


def escape_role(role: Column) -> Column:
    return _swap(escape(role), (":", "\\c"), ("\n", "\\n"))


def format_turns(df: DataFrame, turns_col: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """Adds formatted and loss_spans (struct(start, length) in code points over each loss_role text), in place of such columns.

    An empty or null list of turns gives an empty string and no spans. A conversation is one row,
    however long; its spans are running sums over its turns.
    """
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit(": "))
    pieces = F.transform(F.coalesce(F.col(turns_col), F.array().cast(TURNS)), lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss")))
    own = fresh(df, "_pieces")
    sized = df.withColumn(own, pieces).withColumn("formatted", F.array_join(F.transform(own, lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
    spans = F.aggregate(
        own,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).cast("long").alias("at"),
            F.when(p["loss"], F.array_append(a["spans"], F.struct((a["at"] + F.length(p["head"])).cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length")))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return sized.withColumn("loss_spans", spans["spans"]).drop(own)


def parse_turns(formatted: Column) -> Column:
    """Reads array<struct<role, text>> back from a formatted string."""
    parts = F.filter(F.split(formatted, END), lambda x: x != "")
    colon = lambda x: F.instr(x, ": ")
    return F.transform(parts, lambda x: F.struct(unescape(F.substr(x, F.lit(len(START) + 1), colon(x) - len(START) - 1)).alias("role"), unescape(F.substr(x, colon(x) + 2)).alias("text")))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss spans."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def format_records(df: DataFrame, record_col: str) -> DataFrame:
    """Formats a column of records (VARIANT, struct or JSON text) of any known layout.

    Adds layout, turns, unread, unknown_layout, formatted, loss_spans, in place of columns of these names; others
    stay. Records that aren't JSON, or of an unknown layout, get a null layout and an empty string.
    Repeated rows come back each; an empty table gives none.
    """
    return format_turns(canonical_turns(df, record_col))


def records_from_turn_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, record): rows by turn become one record of the `turns` layout per conversation.

    Rows of a conversation go by turn, then role and text; repeated rows are repeated turns; null
    roles and texts are empty. A conversation is one row, however long; an empty table gives none, and
    other columns are left out.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    return grouped.select("conv_id", F.struct(F.transform("t", lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text"))).alias("turns")).alias("record"))
