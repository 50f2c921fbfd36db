"""Chat formatting with a role automaton, in DataFrame functions only.

A conversation's turns drive a finite-state machine given by a declarative template: every turn takes the machine from
its state to the next one, and the state that it reaches says which text segments are emitted and whether they count
for the loss.  The segments' concatenation is the formatted conversation.  A turn out of order is a fault: the machine recovers in the
state that the template names for the role (so that its text is still formatted, with that state's loss flag) and the
conversation is not ``valid``.  Control strings cannot occur inside texts: the escape character and the two marker
brackets are replaced by two-character codes, reversibly.

Defined results: null text or role counts as empty; turns are ordered by (turn, role, text as it stands),
nulls first, repeated rows all count; an unknown role recovers in state ``other``; a null conv_id
is a conversation of its own; an empty table gives an empty result; extra columns are ignored.

A conversation becomes one row, so it must fit into an executor's memory (2 GB of text is Spark's own limit of a value).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns folded at a time: the fold appends to a list, which costs the square of its length.
BLOCK = 64


@dataclass(frozen=True)
class ChatTemplate:
    """Markers, the automaton's transitions ``(state, role) -> state``, and the states whose texts count for the loss."""

    open_mark: str = "<turn "
    open_end: str = ">\n"
    close_mark: str = "\n</turn>\n"
    loss_states: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    moves: tuple[tuple[str, str, str], ...] = field(
        default=(
            ("start", "system", "system"),
            ("start", "user", "user"),
            ("system", "user", "user"),
            ("user", "assistant", "assistant"),
            ("assistant", "user", "user"),
        )
    )
    #: Where a turn out of order leaves the machine, by its role.
    recover: tuple[tuple[str, str], ...] = (("system", "system"), ("user", "user"), ("assistant", "assistant"))
    other: str = "other"
    #: Escape codes; the escape character itself comes first.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\e"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column, template: ChatTemplate) -> Column:
    for raw, code in template.escapes:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column, template: ChatTemplate) -> Column:
    for raw, code in reversed(template.escapes):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """The value of a literal map, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def step(state: Column, role: Column, t: ChatTemplate) -> tuple[Column, Column]:
    """The state after a turn, and whether the template allows the turn there."""
    legal = lookup({f"{a}\n{r}": b for a, r, b in t.moves}, F.concat(state, F.lit("\n"), role))
    return F.coalesce(legal, lookup(dict(t.recover), role), F.lit(t.other)), legal.isNotNull()


def run_machine(turns: Column, t: ChatTemplate) -> tuple[Column, Column]:
    """(segments, valid) of an array<struct<turn, role, text>>.

    Blocks of turns are folded twice: once for the state in which each begins, once for its segments.
    """
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(turns) - 1) / BLOCK), F.lit(0)).cast("int")), lambda b: F.slice(turns, b * BLOCK + 1, F.lit(BLOCK))
    )

    def pass_turn(s: Column, x: Column) -> Column:
        state, legal = step(s["state"], x["role"], t)
        return F.struct(state.alias("state"), (s["legal"] & legal).alias("legal"))

    def pass_block(s: Column, b: Column) -> Column:
        end = F.aggregate(b, F.struct(s["state"].alias("state"), s["legal"].alias("legal")), pass_turn)
        return F.struct(end["state"].alias("state"), end["legal"].alias("legal"), F.concat(s["starts"], F.array(s["state"])).alias("starts"))

    nothing = F.array().cast("array<struct<text:string,loss:boolean>>")
    begin = F.struct(F.lit(t.start).alias("state"), F.lit(True).alias("legal"), F.array().cast("array<string>").alias("starts"))
    ran = F.aggregate(blocks, begin, pass_block)

    def emit(s: Column, x: Column) -> Column:
        state, _ = step(s["state"], x["role"], t)
        made = [
            (F.concat(F.lit(t.open_mark), escape(x["role"], t), F.lit(t.open_end)), F.lit(False)),
            (escape(x["text"], t), state.isin(*t.loss_states)),
            (F.lit(t.close_mark), F.lit(False)),
        ]
        return F.struct(state.alias("state"), F.concat(s["out"], F.array(*[F.struct(a.alias("text"), b.alias("loss")) for a, b in made])).alias("out"))

    def emit_block(b: Column, state: Column) -> Column:
        return F.aggregate(b, F.struct(state.alias("state"), nothing.alias("out")), emit)["out"]

    return F.flatten(F.zip_with(blocks, ran["starts"], emit_block)), ran["legal"] & ran["state"].isin(*t.accept)


def format_conversations(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments array<struct<text, loss>>, formatted, valid.

    The only shuffle brings a conversation's turns together, as they stand; they are escaped behind it.
    """
    t = template or ChatTemplate()
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segments, valid = run_machine(F.col("turns"), t)
    made = grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"), valid.alias("valid"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted")
    return made.select("conv_id", "n_turns", "segments", formatted, "valid")


def read_turns(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """Parse a formatted conversation back into array<struct<role, text>>."""
    t = template or ChatTemplate()
    parts = F.split(formatted, f"\\Q{t.close_mark}\\E", -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)  # what follows the last mark is empty

    def turn(p: Column) -> Column:
        inner = F.substr(p, F.lit(len(t.open_mark) + 1))
        at = F.instr(inner, t.open_end)
        return F.struct(
            unescape(F.substr(inner, F.lit(1), at - 1), t).alias("role"),
            unescape(F.substr(inner, at + len(t.open_end)), t).alias("text"),
        )

    return F.transform(turns, turn)


def digest(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """The contract's columns, all read back from the machine's output, and its verdict ``valid``."""
    t = template or ChatTemplate()
    back = formatted.withColumn("back", read_turns(F.col("formatted"), t)).withColumn(
        "loss", unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""), t)
    )
    said = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
