"""Chat formatting with a grammar round trip.

Template: a turn is `<s>[INST] ` + role + line break + text + `[/INST]</s>`; a conversation is its turns in order,
nothing between. Grammar: cut at every `[/INST]</s>`; the last piece must be empty; every other piece must start with
`<s>[INST] ` and hold no further control string, but a line break, before which stands the role and after which the
text; in both, the character
references `&lt;` `&lsb;` `&nl;` `&amp;` stand for `<`, `[`, a line break and `&`.

A conversation is first rendered as it is and parsed; if the turns differ from the source, all of its texts that hold
a control string or an `&` are rendered with those escaped, and parsed again. An escaped text holds no
control string, so the second parse gives the source; conversations for which it wouldn't are an error, not a guess.
The loss mask covers the texts of assistant turns as spans [start, stop) of code points of the formatted text.

Only DataFrame functions are used; a conversation's turns are gathered by one aggregate.

Defined results: a null text or role counts as empty; turns of equal number are ordered by role and text, null
numbers first; repeated rows are turns of their own; a row with a null conversation id is a conversation of its own, since
nothing says which belong together; very long texts are kept whole; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

OPEN, CLOSE = "<s>[INST] ", "[/INST]</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column, role: bool = False) -> Column:
    """Replace what could be read as markup, reversibly."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for string in CONTROL:
        out = F.replace(out, F.lit(string), F.lit(("&lt;" if string[0] == "<" else "&lsb;") + string[1:]))
    return F.replace(out, F.lit("\n"), F.lit("&nl;")) if role else out


def unescape(text: Column) -> Column:
    out = text
    for name, char in (("&lt;", "<"), ("&lsb;", "["), ("&nl;", "\n"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def render_turns(turns: Column, escaped: bool) -> Column:
    """The rendered turns of an array of (role, text)."""

    def one(t: Column) -> Column:
        role, text = (escape(t["role"], True), escape(t["text"])) if escaped else (t["role"], t["text"])
        return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))

    return F.transform(turns, one)


def parse(formatted: Column) -> Column:
    """Array of (role, raw_role, raw, text) by the grammar, raw being what stands there; null if it doesn't follow it."""

    def one(piece: Column) -> Column:
        body = F.substring(piece, len(OPEN) + 1, F.char_length(piece))
        role = F.substring_index(body, "\n", 1)
        raw = F.substring(body, F.char_length(role) + 2, F.char_length(body))
        return F.struct(unescape(role).alias("role"), role.alias("raw_role"), raw.alias("raw"), unescape(raw).alias("text"))

    def marked(body: Column) -> Column:
        found = F.lit(False)
        for string in CONTROL:
            found = found | F.contains(body, F.lit(string))
        return found

    def whole(pieces: Column) -> Column:
        turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
        good = (F.element_at(pieces, -1) == "") & F.forall(turns, lambda p: F.startswith(p, F.lit(OPEN)) & (F.locate("\n", p) > 0) & ~marked(F.substring(p, len(OPEN) + 1, F.char_length(p))))
        return F.when(good, F.transform(turns, one))

    return let(F.split(formatted, r"\[/INST\]</s>"), whole)


def conversations(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns): the turns of every conversation in order, as an array of (role, text)."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    turns = rows.select(F.col(id_col).alias("conv"), turn.alias("t"))
    gathered = turns.filter("conv IS NOT NULL").groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("sorted"))
    gathered = gathered.unionByName(turns.filter("conv IS NULL").select("conv", F.array("t").alias("sorted")))
    return gathered.select("conv", F.transform("sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_conversations(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", assistant: str = "assistant") -> DataFrame:
    """(id, formatted, escaped, loss_spans): the formatted text and the spans under the loss mask."""

    def pairs(parsed: Column) -> Column:
        return F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))

    def render(turns: Column, escaped: bool) -> Column:
        return F.array_join(render_turns(turns, escaped), "")

    def finish(turns: Column, formatted: Column, fits: Column) -> Column:
        def spans(parsed: Column) -> Column:
            masked = loss_spans(parsed, assistant)
            failed = F.raise_error(F.lit("the round trip failed")).cast("array<struct<start:bigint,stop:bigint>>")
            return F.struct(formatted.alias("formatted"), (~fits).alias("escaped"), F.when(F.coalesce(pairs(parsed) == turns, F.lit(False)), masked).otherwise(failed).alias("loss_spans"))

        return let(parse(formatted), spans)

    def work(turns: Column) -> Column:
        def choose(plain: Column) -> Column:
            fits = F.coalesce(pairs(parse(plain)) == turns, F.lit(False))
            return let(fits, lambda fit: let(F.when(fit, plain).otherwise(render(turns, True)), lambda chosen: finish(turns, chosen, fit)))

        return let(render(turns, False), choose)

    gathered = conversations(rows, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    return gathered.select(F.col("conv").alias(id_col), let(F.col("turns"), work).alias("done")).select(id_col, "done.*")


def loss_spans(parsed: Column, assistant: str) -> Column:
    """The spans of assistant texts in a formatted text, from its parsed turns; empty texts have empty spans."""
    spans = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), spans.alias("spans"))

    def step(state: Column, t: Column) -> Column:
        first = state["at"] + len(OPEN) + F.char_length(t["raw_role"]) + 1
        last = first + F.char_length(t["raw"])
        found = F.array(F.struct(first.cast("long").alias("start"), last.cast("long").alias("stop")))
        return F.struct((last + len(CLOSE)).cast("long").alias("at"), F.when(t["role"] == assistant, F.concat(state["spans"], found)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(parsed, start, step, lambda state: state["spans"])


def digests(formatted: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """What can be read back from (id, formatted, loss_spans): counts and digests of the turns and of the text under the mask."""
    def read(formatted: Column) -> Column:
        def facts(turns: Column) -> Column:
            joined = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
            return F.struct(F.size(turns).cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"))

        return let(parse(formatted), facts)

    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    loss = let(F.array_join(under, ""), lambda x: F.struct(F.char_length(x).cast("long").alias("loss_chars"), F.sha2(x, 256).alias("loss_sha256")))
    named = formatted.select(id_col, read(F.col("formatted")).alias("t"), loss.alias("l"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return named.select(id_col, "t.n_turns", "t.turns_sha256", "l.loss_chars", "l.loss_sha256", "formatted_chars")
