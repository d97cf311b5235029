"""Chat formatting: a finite-state machine over roles, and a declarative template with loss flags.

All of it is DataFrame expressions. A template names, for each role, what stands before and after a text
and whether the text is trained on. Control strings inside texts are escaped by a backslash after their
first character, and backslashes are doubled, so that the formatted text can be read back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool


@dataclass(frozen=True)
class Template:
    """roles: their marks and loss flags. Any other role stands, escaped, between the marks of other_role."""

    roles: dict[str, Turn] = field(default_factory=lambda: {"system": Turn("<<SYS>>", "<</SYS>>", False), "user": Turn("[INST] ", " [/INST]", False), "assistant": Turn("<s>", "</s>", True)})
    other_role: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    other_after: str = "[/TURN]"
    #: Which role may follow which; "" is the start. A conversation is valid if it also ends in a final role.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        """The marks without outer blanks, longest first."""
        marks = [m.strip() for t in self.roles.values() for m in (t.before, t.after)] + [*self.other_role, self.other_after]
        return sorted(set(marks), key=lambda m: (-len(m), m))


TEMPLATE = Template()


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda c, m: F.replace(c, F.lit(m), F.lit(f"{m[0]}\\{m[1:]}")), template.controls(), out)


def unescape(text: Column, template: Template = TEMPLATE) -> Column:
    """A lone backslash was put there by escape(), a doubled one stands for itself."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _lookup(pairs: dict[str, object], key: Column, otherwise: Column) -> Column:
    return reduce(lambda c, kv: F.when(key == kv[0], F.lit(kv[1])).otherwise(c), pairs.items(), otherwise)


def format_chats(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, segments (text, loss), formatted, is_valid, bad_turn.

    rows has conv_id, turn, role and text; other columns are ignored. Turns are put in order of turn, then
    role, then text, nulls first, so that ties and repeated rows have one result. A null text or role is
    empty; a null conv_id is a conversation of its own. Conversations that break the order of roles are
    formatted all the same, with is_valid false and bad_turn the place of the first turn that may not stand
    there (-1: none; the number of turns if only the end is wrong). One shuffle, by conv_id. Very long texts and
    conversations are whole: a conversation is one row, as its output is, and must fit a task. An empty table
    gives an empty result.
    """
    turn = F.struct(rows["turn"].alias("turn"), rows["role"].alias("role"), rows["text"].alias("text"))
    chats = rows.groupBy(rows["conv_id"].alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(t: Column) -> Column:
        role, text = F.coalesce(t["role"], F.lit("")), escape(F.coalesce(t["text"], F.lit("")), template)
        a, b = template.other_role
        before = _lookup({r: x.before for r, x in template.roles.items()}, role, F.concat(F.lit(a), escape(role, template), F.lit(b)))
        after = _lookup({r: x.after for r, x in template.roles.items()}, role, F.lit(template.other_after))
        loss = _lookup({r: x.loss for r, x in template.roles.items()}, role, F.lit(False))
        part = lambda c, on: F.struct(c.alias("text"), on.alias("loss"))
        return F.array(part(before, F.lit(False)), part(text, loss), part(after, F.lit(False)))

    allowed = F.lit(False)
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))

    def step(acc: Column, t: Column) -> Column:
        role = F.coalesce(t["role"], F.lit(""))
        may = reduce(lambda c, kv: c | ((acc["state"] == kv[0]) & role.isin(*kv[1])), template.follows.items(), allowed)
        bad = F.when((acc["bad"] < 0) & ~may, acc["at"]).otherwise(acc["bad"])
        return F.struct(role.alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    end = F.aggregate("turns", start, step)
    out = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", piece)).alias("segments"), end.alias("end"))
    bad = F.when(F.col("end.bad") >= 0, F.col("end.bad")).when(~F.col("end.state").isin(*template.final), F.col("end.at")).otherwise(-1)
    return out.select("conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), (bad < 0).alias("is_valid"), bad.cast("long").alias("bad_turn"))


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns (role, text) of a formatted conversation, from its text alone."""
    (a, b), end = template.other_role, template.other_after
    q = re.escape
    one = [f"{q(t.before)}.*?{q(t.after)}" for t in template.roles.values()] + [f"{q(a)}.*?{q(b)}.*?{q(end)}"]
    found = F.regexp_extract_all(formatted, F.lit(f"(?s){'|'.join(one)}"), F.lit(0))

    def turn(raw: Column) -> Column:
        inner = raw.substr(F.lit(len(a) + 1), F.length(raw) - (len(a) + len(end)))
        role, text = F.substring_index(inner, b, 1), inner.substr(F.locate(b, inner) + len(b), F.length(inner))
        for name, t in template.roles.items():
            known = raw.startswith(t.before)
            text = F.when(known, raw.substr(F.lit(len(t.before) + 1), F.length(raw) - (len(t.before) + len(t.after)))).otherwise(text)
            role = F.when(known, F.lit(name)).otherwise(role)
        return F.struct(unescape(role, template).alias("role"), unescape(text, template).alias("text"))

    return F.transform(found, turn)


def chat_digests(chats: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Digests of what format_chats() put out: the turns read from the text, the loss from the segments."""
    turns = read_turns(F.col("formatted"), template)
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    out = chats.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "is_valid", "bad_turn")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "is_valid", "bad_turn")
