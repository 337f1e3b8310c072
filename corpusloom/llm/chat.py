"""Operator 3: chat formatting by schema fingerprints, in DataFrame functions only.

A layout is known by its fingerprint: the hash of its nested field paths, written as a shape.  `Layout` entries are declarative: paths, and
where turns lie.  A typed table's fingerprint comes from its schema; a column of JSON records has one a record, as
`schema_of_variant` lists the paths of each.  The fingerprint selects the mapping, and only the mapping says which columns are read.  All layouts
become canonical turns (role, text), which one template renders, with spans of the loss mask, and which `read_back`
parses again from the rendered text alone.

Template: ``### role: text</turn>`` and a newline a turn.  Inside texts ``\\`` becomes ``\\\\``, ``#`` ``\\h`` and ``<`` ``\\l``; in roles also
``:`` ``\\c``; so no text can hold a mark, and unescaping is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """`paths` are its nested field paths; `turns` lists (role, path) in order, `each` names an array with role and text fields, or `row` order, role and text of rows that are turns."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    row: tuple[str, str, str] | None = None


#: Known layouts; roles are renamed by ROLES.
LAYOUTS = (
    Layout("turn_rows", ("role", "text", "turn"), row=("turn", "role", "text")),
    Layout("messages", ("messages[].content", "messages[].role"), each=("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), each=("conversations", "from", "value")),
    Layout("dialogue", ("turns[].speaker", "turns[].utterance"), each=("turns", "speaker", "utterance")),
    Layout("instruction_input", ("input", "instruction", "output"), (("user", "instruction"), ("user_more", "input"), ("assistant", "output"))),
    Layout("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout("prompt_completion", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt_response", ("prompt", "response", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", ("answer", "question"), (("user", "question"), ("assistant", "answer"))),
    Layout("nested_prompt", ("prompt.system", "prompt.user", "response.text"), (("system", "prompt.system"), ("user", "prompt.user"), ("assistant", "response.text"))),
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(shape: Column) -> Column:
    return F.sha2(shape, 256)


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a type: a.b for structs, a[] for arrays."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def table_layout(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """The layout whose fingerprint the table has in the columns that the layout names, of several the one with most paths; other columns are extra."""
    known = {printed(shape_of(x.paths)): x for x in layouts}
    found = []
    for x in layouts:
        tops = {re.split(r"[.\[]", p)[0] for p in x.paths}
        part = T.StructType([f for f in schema.fields if f.name in tops])
        found.append(known.get(printed(shape_of(schema_paths(part)))))
    return max((x for x in found if x), key=lambda x: len(x.paths), default=None)


def printed(shape: str) -> str:
    """What `fingerprint` gives for a shape."""
    return hashlib.sha256(shape.encode()).hexdigest()


def json_signature(record: Column) -> Column:
    """The sorted paths of a variant record's shape, in the notation of `Layout.paths`, from its schema text.

    Values' types are dropped, names stay; the schema lists fields in name order, so equal shapes have equal texts.
    """
    shape = F.schema_of_variant(record)
    shape = F.regexp_replace(shape, r"(?<=[:<] ?)(STRING|BIGINT|BOOLEAN|DOUBLE|FLOAT|VOID|VARIANT|BINARY|DATE|TIMESTAMP(_NTZ)?|DECIMAL\(\d+,\s*\d+\))(?=[,>])", "*")
    return shape


def shape_of(paths: Iterable[str]) -> str:
    """What json_signature gives for records of these nested field paths."""
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path.split("."):
            at = at.setdefault(part, {})

    def text(node: dict) -> str:
        inner = []
        for name in sorted(node, key=lambda n: n.removesuffix("[]")):
            below = text(node[name]) if node[name] else "*"
            inner.append(f"{name.removesuffix('[]')}: {f'ARRAY<{below}>' if name.endswith('[]') else below}")
        return f"OBJECT<{', '.join(inner)}>"

    return text(tree)


def role_name(role: Column) -> Column:
    low = F.lower(F.trim(role))
    out = F.coalesce(low, F.lit(""))
    for k, v in ROLES.items():
        out = F.when(low == k, v).otherwise(out)
    return out


def turn_of(role: str, text: str) -> Callable[[Column], Column]:
    return lambda t: F.struct(role_name(t[role]).alias("role"), F.coalesce(t[text], F.lit("")).alias("text"))


def canonical_json(records: DataFrame, column: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """`records` with layout, fingerprint and turns (role, text) of a JSON string column.

    Records that are null, broken or of an unknown shape have a null layout and no turns, and stay in the result;
    null texts are empty; an empty second instruction is no turn.
    """
    variant = F.try_parse_json(F.col(column).cast("string"))
    print_of = fingerprint(json_signature(variant))
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    get = lambda p, kind: F.try_variant_get(variant, f"$.{p}", kind)
    for x in layouts:
        if x.name == "turn_rows":
            continue
        same = print_of == F.lit(printed(shape_of(x.paths)))
        if x.each:
            where, role, text = x.each
            got = F.transform(get(where, f"array<struct<`{role}`:string,`{text}`:string>>"), turn_of(role, text))
        else:
            made = [F.struct(F.lit(r).alias("role"), F.coalesce(get(p, "string"), F.lit("")).alias("text")) for r, p in x.turns]
            got = F.filter(F.array(*made), lambda t: ~((t["role"] == "user_more") & (t["text"] == "")))
            got = F.transform(got, lambda t: F.struct(F.when(t["role"] == "user_more", "user").otherwise(t["role"]).alias("role"), t["text"].alias("text")))
        name = F.when(same, F.lit(x.name)).otherwise(name)
        turns = F.when(same, got).otherwise(turns)
    return records.withColumns({"layout": name, "fingerprint": print_of, "turns": F.coalesce(turns, F.array().cast(TURNS))})


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    """Doubled backslashes pair from the left, so between them every backslash starts a mark."""
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(text, re.escape("\\\\")), plain), "\\")


def rendered(turn_rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, formatted, loss): the text of each conversation and the spans (start, length in code points) of its loss mask.

    `turn_rows` has key, turn, role and text.  Rows are ordered by turn, then role and text; null turns come first; null roles
    and texts are empty.  Only turns of the role "assistant" are under the mask.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turn_rows.select(F.col(key).alias("_k"), F.col("turn").alias("_t"), role.alias("_r"), text.alias("_x"))
    head = F.concat(F.lit(HEAD), escape(F.col("_r"), True), F.lit(MIDDLE))
    rows = rows.withColumns({"_head": head, "_body": escape(F.col("_x"))})
    from pyspark.sql import Window

    order = Window.partitionBy("_k").orderBy(F.col("_t").asc_nulls_first(), "_r", "_x")
    size = F.length("_head") + F.length("_body") + F.lit(len(END))
    at = F.coalesce(F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"_at": at, "_n": F.row_number().over(order)})
    loss = F.struct((F.col("_at") + F.length("_head")).alias("start"), F.length("_body").cast("long").alias("length"))
    part = F.struct(F.col("_n").alias("n"), F.concat("_head", "_body", F.lit(END)).alias("x"), F.when(F.col("_r") == "assistant", loss).alias("loss"))
    done = rows.groupBy("_k").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    spans = F.transform(F.filter("parts", lambda p: p["loss"].isNotNull()), lambda p: p["loss"])
    return done.select(F.col("_k").alias(key), F.array_join(F.transform("parts", lambda p: p["x"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the rendered text holds: (key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    pieces = F.split("formatted", re.escape(END))
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    role = lambda x: F.substring_index(x, MIDDLE, 1)
    text = lambda x: F.substring(x, F.length(role(x)) + F.lit(len(MIDDLE) + 1), F.length(x))
    line = lambda x: F.concat(unescape(F.substring(role(x), F.lit(len(HEAD) + 1), F.length(x))), F.lit("\n"), unescape(text(x)), F.lit("\n"))
    told = F.array_join(F.transform(turns, line), "")
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.select(
        key, F.size(turns).cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def canonical_turns(table: DataFrame, key: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, turn, role, text) of a typed table by the mapping that its fingerprint selects; an unknown one raises ValueError.

    Rows that are turns keep their roles as they are; roles of other layouts are renamed.  Null arrays have no turns; an empty
    second instruction is no turn.
    """
    layout = table_layout(table.schema, layouts)
    if layout is None:
        raise ValueError(f"no known layout: {schema_paths(table.schema)}")
    if layout.row:
        order, role, text = layout.row
        return table.select(F.col(key).alias(key), F.col(order).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    if layout.each:
        where, role, text = layout.each
        turns = F.transform(F.col(where), turn_of(role, text))
    else:
        made = [F.struct(F.lit(r.removesuffix("_more")).alias("role"), F.coalesce(F.col(p).cast("string"), F.lit("")).alias("text"), F.lit(r.endswith("_more")).alias("more")) for r, p in layout.turns]
        turns = F.filter(F.array(*made), lambda t: ~(t["more"] & (t["text"] == "")))
    return table.select(F.col(key).alias(key), F.posexplode(turns).alias("turn", "_turn")).select(key, "turn", "_turn.role", "_turn.text")


def format_table(table: DataFrame, key: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Formatted conversations of a typed table of any known layout."""
    return rendered(canonical_turns(table, key, layouts), key)


def format_json(records: DataFrame, column: str, key: str) -> DataFrame:
    """Formatted conversations of a JSON column of any known layouts, one a record; records without turns give none."""
    turns = canonical_json(records, column).select(key, F.posexplode("turns").alias("turn", "_turn"))
    return rendered(turns.select(key, "turn", "_turn.role", "_turn.text"), key)
