"""Chat formatting, in DataFrame functions alone.

Records come in several layouts: lists of messages under various names,
prompt and completion, instruction, input and output. A record's layout is
recognised by a fingerprint, the hash of the nested field paths that the record
itself fills; each fingerprint selects a declarative mapping to canonical turns. The turns are
written in one template that can be read back without loss.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A turn is OPEN, the escaped role, MIDDLE, the escaped text, CLOSE.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
#: Characters that get a backslash inside roles and texts, so that no marker stands within.
ESCAPED = r"([\\#<:])"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A record layout. paths: the nested fields it fills (of messages, one at least). Either messages, with the fields of role and text; or parts, of (role, fields joined by a blank line)."""

    name: str
    paths: tuple[str, ...]
    messages: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def admits(self) -> list[tuple[str, ...]]:
        """Sets of paths that a record of this layout may fill: messages may all lack a role, or a text."""
        return [self.paths, *[(p,) for p in self.paths]] if self.messages else [self.paths]


#: Field names of common public layouts.
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), messages=("messages", "role", "content")),
    Layout("turns", ("conversations[].from", "conversations[].value"), messages=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt", ("prompt", "completion"), parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt-response", ("prompt", "response"), parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction-input", ("instruction", "input", "output"), parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question", ("question", "answer"), parts=(("user", ("question",)), ("assistant", ("answer",)))),
)


Test = Callable[[Column], Column]


def _of_some(test: Test) -> Test:
    return lambda v: F.coalesce(F.exists(v, lambda x: test(x)), F.lit(False))


def _of_field(test: Test, name: str) -> Test:
    return lambda v: test(v[name])


def _leaves(kind: T.DataType, name: str) -> list[tuple[str, Test]]:
    """Nested field paths of a value, each with the test whether the value fills it: some leaf there is not null."""
    if isinstance(kind, T.ArrayType):
        return [(path, _of_some(test)) for path, test in _leaves(kind.elementType, f"{name}[]")]
    if isinstance(kind, T.StructType):
        return [(path, _of_field(test, f.name)) for f in kind.fields for path, test in _leaves(f.dataType, f"{name}.{f.name}")]
    return [(name, lambda v: v.isNotNull())]


def path_hash(paths) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def _known_leaves(df: DataFrame, layouts: tuple[Layout, ...]) -> dict[str, Column]:
    """Of the paths that layouts name and the table has, whether a row fills each."""
    named = {p for x in layouts for p in x.paths}
    columns = {p.split(".")[0].split("[")[0] for p in named}
    return {path: test(F.col(f"`{f.name}`")) for f in df.schema.fields if f.name in columns for path, test in _leaves(f.dataType, f.name) if path in named}


def fingerprint(filled: dict[str, Column]) -> Column:
    """Hash of the nested field paths that a record itself fills, of those given; fields that no layout names (a name, a time) do not count."""
    return F.xxhash64(F.array_join(F.array(*[F.when(filled[p], F.lit(p)) for p in sorted(filled)]), "\n"))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(layout: Layout) -> Column:
    if layout.messages:
        column, role, text = layout.messages
        named = lambda r: F.coalesce(*[F.when(r == a, F.lit(b)) for a, b in layout.roles], r) if layout.roles else r
        return F.transform(F.col(column), lambda m: _turn(named(m[role]), m[text])).cast(TURNS)
    return F.array(*[_turn(F.lit(role), F.array_join(F.filter(F.array(*map(F.col, fields)), lambda x: x != ""), "\n\n")) for role, fields in layout.parts]).cast(TURNS)


def canonical_turns(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Array of (role, text) of each record; null where no layout has its fingerprint. Null texts and roles are empty."""
    filled = _known_leaves(df, layouts)
    known = [x for x in layouts if {*x.paths} <= {*filled}]
    if not known:
        raise ValueError(f"no columns of a known layout among {df.columns}")
    found = fingerprint(filled)
    return F.coalesce(*[F.when(found.isin(*[path_hash(p) for p in x.admits()]), _turns(x)) for x in known], F.lit(None).cast(TURNS))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: Column) -> Column:
    """All turns in the template, one after the other."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(CLOSE))), "")


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """Spans (begin, size) in code points of the formatted text that the loss is taken over: the texts of one role, escaped as they stand."""
    head = lambda t: F.lit(len(OPEN) + len(MIDDLE)) + F.length(escape(t["role"]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,size:int>>").alias("spans"))

    def step(acc, t):
        size = F.length(escape(t["text"]))
        span = F.struct((acc["at"] + head(t)).alias("begin"), size.alias("size"))
        return F.struct((acc["at"] + head(t) + size + F.lit(len(CLOSE))).alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_records(df: DataFrame, *, id_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Records in the template: the id, layout_turns (null if no layout fits), formatted, loss_spans.

    A record of an unknown layout has null turns, an empty text and no spans:
    it is reported, not dropped; so is one whose fields are all null, or whose
    list is empty. Records are formatted row by row, repeated rows each, and
    nothing is shuffled; an empty table gives no rows. Roles and texts may be
    as long as a string may be, for no expression recurses over characters.
    """
    out = df.select(F.col(id_col), canonical_turns(df, layouts).alias("layout_turns"))
    turns = F.coalesce("layout_turns", F.array().cast(TURNS))
    return out.select("*", formatted(turns).alias("formatted"), loss_spans(turns).alias("loss_spans"))


def read_back(text: Column) -> Column:
    """The turns of a formatted text."""
    # The last part, after the last CLOSE, is empty. No CLOSE stands inside a turn, as < is escaped there.
    blocks = F.split(text, r" </turn>\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)
    # The role ends at the first MIDDLE of which the colon is not escaped. Possessive, so that the matcher loops instead of recursing.
    role = lambda b: F.regexp_extract(b, r"(?s)^### ((?:[^\\:]++|\\.)*+): ", 1)
    named = F.transform(blocks, lambda b: F.struct(role(b).alias("role"), b.alias("block")))
    text = lambda x: F.substring(x["block"], F.length(x["role"]) + len(OPEN) + len(MIDDLE) + 1, F.length(x["block"]))
    return F.transform(named, lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(text(x)).alias("text")))


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, s["begin"] + 1, s["size"]))), "")


def records(conversations: DataFrame) -> DataFrame:
    """Rows of single turns (conv_id, turn, role, text) as records of the messages layout; turns of equal number follow role and text."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    return grouped.select("conv_id", F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def in_layouts(messages: DataFrame) -> DataFrame:
    """Records of the messages layout (conv_id, messages), each moved to one of the layouts that can hold it without loss; the columns of the others are null.

    A question and an answer fit all layouts; other records fit messages, and
    turns if no role has a name that turns give another meaning.
    """
    m, which = F.col("messages"), F.pmod(F.xxhash64("conv_id"), F.lit(len(LAYOUTS)))
    first, second = F.get(m, F.lit(0)), F.get(m, F.lit(1))
    asked, answered = first["content"], second["content"]
    pair = (F.size(m) == 2) & first["role"].eqNullSafe("user") & second["role"].eqNullSafe("assistant") & asked.isNotNull() & answered.isNotNull()
    at = F.locate("\n\n", asked)
    two = pair & (at > 1) & (F.length(asked) > at + 1)
    plain = ~F.exists(m, lambda x: F.coalesce(x["role"].isin("human", "gpt"), F.lit(False)))
    fits = {"messages": F.lit(True), "turns": plain, "instruction-input": two}
    number = {x.name: i for i, x in enumerate(LAYOUTS)}
    is_ = {x: (which == number[x]) & fits.get(x, pair) for x in number}
    said = lambda r: F.when(r == "user", F.lit("human")).when(r == "assistant", F.lit("gpt")).otherwise(r)
    turns = F.transform(m, lambda x: F.struct(said(x["role"]).alias("from"), x["content"].alias("value")))
    moved = is_["turns"] | is_["prompt"] | is_["prompt-response"] | is_["instruction"] | is_["instruction-input"] | is_["question"]
    return messages.select(
        "conv_id", F.when(~moved, m).alias("messages"), F.when(is_["turns"], turns).alias("conversations"),
        F.when(is_["prompt"] | is_["prompt-response"], asked).alias("prompt"), F.when(is_["prompt"], answered).alias("completion"), F.when(is_["prompt-response"], answered).alias("response"),
        F.when(is_["instruction"], asked).when(is_["instruction-input"], F.substring(asked, F.lit(1), at - 1)).alias("instruction"), F.when(is_["instruction-input"], F.substring(asked, at + 2, F.length(asked))).alias("input"),
        F.when(is_["instruction"] | is_["instruction-input"], answered).alias("output"), F.when(is_["question"], asked).alias("question"), F.when(is_["question"], answered).alias("answer"),
    )
