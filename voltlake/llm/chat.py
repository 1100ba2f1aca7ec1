"""Chat formatting with DataFrame functions only: a finite-state machine over roles, and a declarative template.

`format_chat` returns one row per conversation: its text, its segments with a loss flag each, the state the machine
ends in, whether the order of turns is valid, and the first turn that is out of order. Only the four named columns are
read; others of any name are ignored.

* null text: empty; null role: the empty role, which no transition allows, so the conversation is not valid but formatted all the same
* a role that the template does not name: marked by its own (escaped) name, without loss
* turns are ordered by `turn`, nulls first; ties by role, then text, so that the result is defined; repeated rows are turns of their own
* a null conversation id is a conversation like any other
* control strings inside texts are escaped, so what a text says never ends or opens a turn; `parse_chat` gives back role and text of each turn
* an empty table gives an empty result
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around turns. All control strings begin with `lead`, one character; texts hold none after escaping."""

    open: str = "<|turn:"
    mark: str = "|>"
    close: str = "<|end|>"
    lead: str = "<"
    #: Roles of which the text counts in the loss.
    loss: frozenset[str] = frozenset({"assistant"})
    #: State -> roles that may follow -> the state they lead to.
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "primed", "user": "asked"},
            "primed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    #: States in which a conversation may end.
    final: frozenset[str] = frozenset({"asked", "answered"})

    def escapes(self) -> list[tuple[str, str]]:
        """In this order to escape, in reverse to read back. The escape character comes first; each escape has its own letter."""
        return [("\\", "\\e"), (self.lead, "\\l"), (self.mark[0], "\\m")]


TEMPLATE = Template()


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), template.escapes(), text)


def unescape(text: Column, template: Template = TEMPLATE) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(template.escapes()), text)


def _step(state: Column, role: Column, template: Template) -> Column:
    """The state after `role`; null where the machine has no such transition."""
    found = F.lit(None).cast("string")
    for source, moves in template.transitions.items():
        for name, target in moves.items():
            found = F.when((state == source) & (role == name), target).otherwise(found)
    return found


def format_chat(conversations: DataFrame, template: Template = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, n_turns, formatted, segments (text, loss), state, valid, first_invalid (0-based, null if none)."""
    role_of, text_of = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    turns = conversations.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), role_of.alias("role"), text_of.alias("text")).alias("one"))
    grouped = turns.groupBy("conv").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    opened = lambda t: F.concat(F.lit(template.open), escape(t["role"], template), F.lit(template.mark))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(opened(t), F.lit(False)),
                segment(escape(t["text"], template), t["role"].isin(*sorted(template.loss)) if template.loss else F.lit(False)),
                segment(F.lit(template.close), F.lit(False)),
            ),
        )
    )
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    machine = F.aggregate(
        "turns",
        start,
        lambda s, t: F.struct(
            F.coalesce(_step(s["state"], t["role"], template), F.lit("invalid")).alias("state"),
            (s["n"] + 1).alias("n"),
            F.coalesce(s["bad"], F.when(_step(s["state"], t["role"], template).isNull(), s["n"])).alias("bad"),
        ),
    )
    return (
        grouped.withColumns({"segments": segments, "machine": machine})
        .select(
            F.col("conv").alias(conv),
            F.size("turns").cast("long").alias("n_turns"),
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            "segments",
            F.col("machine.state").alias("state"),
            (F.col("machine.bad").isNull() & F.col("machine.state").isin(*sorted(template.final))).alias("valid"),
            F.col("machine.bad").alias("first_invalid"),
        )
    )


def parse_chat(formatted: Column, template: Template = TEMPLATE) -> Column:
    """Role and text of each turn of a formatted conversation, as it was before."""
    literal = lambda s: "\\Q" + s + "\\E"
    parts = F.split(formatted, literal(template.close), -1)
    turns = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    body = lambda t: F.substring(t, F.lit(1 + len(template.open)), F.length(t))
    role = lambda t: F.substring_index(body(t), template.mark, 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(role(t), template).alias("role"),
            unescape(F.substring(body(t), F.length(role(t)) + F.lit(1 + len(template.mark)), F.length(t)), template).alias("text"),
        ),
    )


def digests(formatted: DataFrame, template: Template = TEMPLATE, conv: str = "conv_id") -> DataFrame:
    """What the output says, read back: turns from the formatted text, text under the loss mask from the segments."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    return (
        formatted.withColumns({"turns": parse_chat(F.col("formatted"), template), "under_loss": loss})
        .select(
            conv,
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(turns, 256).alias("turns_sha256"),
            F.length("under_loss").cast("long").alias("loss_chars"),
            F.sha2("under_loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "valid",
        )
    )
