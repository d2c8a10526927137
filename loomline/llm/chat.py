r"""Chat formatting: conversations of many layouts to canonical turns, and turns to one text.

Layouts. Of the nested field paths that a table, or a JSON document, has, those that a declared layout
names are hashed; the first layout whose own hash that is gives the mapping to turns (role, text).
Layouts with more paths come first, and of equals those declared first, so other columns don't
matter, even such as another layout names. An unknown layout gives null turns.

Template. Each turn is written `<|im_start|>ROLE\nTEXT<|im_end|>\n`. Inside roles and texts `~`
is written `~0` and `<|` is written `~1`, and in roles a line feed `~2`: so no text can hold a
control string, and reading back is exact. The loss mask covers the texts of assistant turns.

Edge cases: a null role or text is empty; turns are ordered by turn, role, text, nulls first, so
ties and repeated rows have one order; a null conversation id is one conversation; an empty table
gives no rows. A conversation is one row of output and so is gathered whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import unused
from loomline.llm.text_stats import let

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"

#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type; [] stands for an array's elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}".lstrip("."))]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    return [at]


def _pair(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.cast("string").alias("text"))


def _listed(role: str, text: str) -> Callable[[Callable[[str], Column]], Column]:
    def of(get: Callable[[str], Column], field: str) -> Column:
        named = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
        return F.transform(get(field), lambda m: F.struct(F.coalesce(named[F.coalesce(m[role], F.lit(""))], m[role]).alias("role"), m[text].alias("text")))

    return of


def _asked(user: list[str], answer: str) -> Callable[[Callable[[str], Column]], Column]:
    def of(get: Callable[[str], Column]) -> Column:
        ask = F.concat_ws("\n", *(F.when(F.length(get(x)) > 0, get(x)) for x in user))
        return F.array(_pair("user", ask), _pair("assistant", F.coalesce(get(answer), F.lit(""))))

    return of


#: Declared layouts: the paths that tell one, and the turns they hold.
LAYOUTS: dict[str, tuple[list[str], Callable]] = {
    "messages": (["messages[].role", "messages[].content"], lambda get: _listed("role", "content")(get, "messages")),
    "from_value": (["conversations[].from", "conversations[].value"], lambda get: _listed("from", "value")(get, "conversations")),
    "instruction_input": (["instruction", "input", "output"], _asked(["instruction", "input"], "output")),
    "instruction": (["instruction", "output"], _asked(["instruction"], "output")),
    "prompt_completion": (["prompt", "completion"], _asked(["prompt"], "completion")),
    "prompt_response": (["prompt", "response"], _asked(["prompt"], "response")),
    "question_answer": (["question", "answer"], _asked(["question"], "answer")),
}
ROWS = ["conv_id", "turn", "role", "text"]
KNOWN = sorted({p for layout, _ in LAYOUTS.values() for p in layout})
#: The layouts' fingerprints, the most specific first.
BY_HASH = {name: fingerprint(LAYOUTS[name][0]) for name in sorted(LAYOUTS, key=lambda x: -len(LAYOUTS[x][0]))}


def layout_of(have: list[str]) -> str | None:
    """The name of the first layout that the paths fit."""
    return next((name for name, h in BY_HASH.items() if fingerprint([p for p in have if p in LAYOUTS[name][0]]) == h), None)


def canonical(df: DataFrame) -> DataFrame:
    """The table's rows with `turns`, by the mapping that its schema's fingerprint selects.

    A table of one row a turn (conv_id, turn, role, text) is gathered by conversation; a column
    `turns` that another table has is replaced.
    """
    have = paths(df.schema)
    if fingerprint([p for p in have if p in ROWS]) == fingerprint(ROWS):
        turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        kept = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return df.groupBy("conv_id").agg(kept.alias("turns"))
    name = layout_of(have)
    turns = LAYOUTS[name][1](lambda f: F.col(f"`{f}`")) if name else F.lit(None)
    return df.withColumn("turns", turns.cast(TURNS))


def canonical_json(df: DataFrame, json_col: str = "json") -> DataFrame:
    """The rows with `layout` and `turns`: each row's JSON may have another layout.

    Text that isn't JSON, and an unknown layout, give null turns.
    """
    field = "struct<" + ",".join(["messages:array<struct<role:string,content:string>>", "conversations:array<struct<`from`:string,value:string>>"] + [f"`{p}`:string" for p in KNOWN if "[]" not in p]) + ">"
    doc, present = unused([*df.columns, "layout", "turns"], "doc", "present")
    out = df.withColumn(doc, F.from_json(F.col(json_col), field))

    def there(p: str) -> Column:
        if "[]." not in p:
            return F.col(doc)[p].isNotNull()
        top, leaf = p.split("[].")
        return F.exists(F.col(doc)[top], lambda m: m[leaf].isNotNull())

    out = out.withColumn(present, F.array_compact(F.array(*(F.when(there(p), F.lit(p)) for p in KNOWN))))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, h in reversed(BY_HASH.items()):
        own = F.array(*map(F.lit, LAYOUTS[name][0]))
        fits = F.sha2(F.array_join(F.array_intersect(present, own), "\n"), 256) == h
        layout = F.when(fits, F.lit(name)).otherwise(layout)
        turns = F.when(fits, LAYOUTS[name][1](lambda f: F.col(doc)[f]).cast(TURNS)).otherwise(turns)
    return out.withColumns({"layout": layout, "turns": turns}).drop(doc, present)


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("~1"))
    return F.replace(out, F.lit("\n"), F.lit("~2")) if role else out


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~2"), F.lit("\n")), F.lit("~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def formatted(turns: Column) -> Column:
    """The turns as one text."""
    one = lambda t: F.concat(F.lit(START), escaped(t["role"], True), F.lit("\n"), escaped(t["text"]), F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def parts(text: Column) -> Column:
    """The turns of a formatted text, escaped as they stand, with their loss flag."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda x: F.length(x) > 0)
    body = lambda x: F.substr(x, F.lit(len(START) + 1))
    role = lambda x: F.substring_index(body(x), "\n", 1)
    return F.transform(
        pieces,
        lambda x: F.struct(role(x).alias("role"), F.substr(x, F.length(role(x)) + len(START) + 2).alias("text"), (role(x) == "assistant").alias("loss")),
    )


def read_back(text: Column) -> Column:
    """The turns (role, text, loss) that a formatted text holds."""
    return F.transform(parts(text), lambda t: F.struct(unescaped(t["role"]).alias("role"), unescaped(t["text"]).alias("text"), t["loss"].alias("loss")))


def loss_spans(text: Column) -> Column:
    """The loss mask: [start, end) code points of the formatted text that are trained on."""
    edge = len(START) + 1 + len(END)

    def of(p: Column) -> Column:
        size = lambda t: F.length(t["role"]) + F.length(t["text"]) + edge
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(a: Column, t: Column) -> Column:
            start = a["at"] + len(START) + 1 + F.length(t["role"])
            span = F.struct(start.alias("start"), (start + F.length(t["text"])).alias("end"))
            return F.struct((a["at"] + size(t)).alias("at"), F.when(t["loss"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

        return F.aggregate(p, zero, step, lambda a: a["spans"])

    return let(parts(text), of)


def render(df: DataFrame) -> DataFrame:
    """Canonical rows with `formatted`, the conversation as one text."""
    return df.withColumn("formatted", formatted(F.col("turns")))


def digest(rendered: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the texts and their loss masks."""
    f = F.col("formatted")
    lines = F.array_join(F.transform(read_back(f), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    under = F.transform(loss_spans(f), lambda s: unescaped(F.substr(f, s["start"] + 1, s["end"] - s["start"])))
    back = rendered.select(
        "conv_id", F.size(parts(f)).cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.array_join(under, "").alias("loss"), F.length(f).cast("long").alias("formatted_chars")
    )
    return back.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
