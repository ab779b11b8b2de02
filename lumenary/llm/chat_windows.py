"""Chat formatting in budgeted windows.

A conversation is cut into windows of whole turns by the prefix sums of its turns' tokens. Every window after
the first repeats the leading system turn and a limited history; what is repeated is never a target again.
Built-in functions only. The turns' numbers of a conversation meet in one row; their texts meet by window, so a
text is only ever together with those of its window.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a window, and of the history that it repeats at most.
BUDGET, HISTORY = 1024, 256
#: A token is taken as so many bytes.
TOKEN_BYTES = 4

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
SYSTEM, TARGET = "system", "assistant"
#: Control strings of this template and of other common ones, and what stands for them inside a text.
ESCAPES = [("~", "~0"), ("<|", "~1"), ("[INST]", "~2"), ("[/INST]", "~3"), ("<s>", "~4"), ("</s>", "~5")]


def escaped(text: Column) -> Column:
    """No control string is left in the result; `~` is escaped itself, so `unescaped` gives the text back."""
    return functools.reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescaped(text: Column) -> Column:
    return functools.reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def token_count(piece: Column) -> Column:
    return F.ceil(F.octet_length(piece) / TOKEN_BYTES).cast("long")


def format_windows(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    budget: int = BUDGET, history: int = HISTORY,
) -> DataFrame:
    """(id, window, text, repeated, mask): `repeated` leading turns of the window stood in an earlier one.

    `mask` lists the start (from 0) and length of every target's text. A window holds as many whole turns as
    its budget takes next to the system turn and the history, and one at least, so a turn larger than the
    budget has a window alone. Turns go by number, a null number first, ties by role and text; repeated rows
    are turns each; null roles and texts are empty; rows of a null id are one conversation. Only the named
    columns are read.
    """
    rows = conversations.select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    rows = rows.withColumns({"head": head, "body": escaped(F.col("text"))}).withColumn("piece", F.concat("head", "body", F.lit(END)))
    rows = rows.select("id", "turn", "role", "text", "piece", F.length("head").alias("n_head"), F.length("body").alias("n_body"), token_count(F.col("piece")).alias("tokens"))
    order = Window.partitionBy("id").orderBy("turn", "role", "text")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "i": F.row_number().over(order) - 1,
            "before": F.coalesce(F.sum("tokens").over(past), F.lit(0)),
        }
    )
    rows = rows.withColumn("lead", (F.col("i") == 0) & (F.col("role") == SYSTEM))
    # turns that start within `history` tokens before this one, the system turn apart
    near = Window.partitionBy("id").orderBy("before").rangeBetween(-history, -1)
    rows = rows.withColumns({"n_past": F.count_if(~F.col("lead")).over(near), "past": F.coalesce(F.sum(F.when(~F.col("lead"), F.col("tokens"))).over(near), F.lit(0))})
    rows = rows.withColumn("talk", F.struct("id"))  # a null id is a conversation too
    numbers = F.struct(*[F.col(c).cast("long").alias(c) for c in ("i", "before", "tokens", "past", "n_past")], "lead")
    talks = rows.groupBy("talk").agg(F.sort_array(F.collect_list(numbers)).alias("turns"))
    first = F.col("turns")[0]
    talks = talks.withColumns({"n_lead": first["lead"].cast("int"), "lead_tokens": F.when(first["lead"], first["tokens"]).otherwise(0)})

    start = F.struct(F.array(F.lit(0).cast("long")).alias("starts"), F.lit(0).cast("long").alias("base"))

    def advance(state: Column, t: Column) -> Column:
        # base: prefix sum at which the window's tokens begin, less what it repeats
        over = (t["i"] > F.element_at(state["starts"], -1)) & (t["before"] + t["tokens"] - state["base"] > budget)
        fresh = F.struct(F.concat(state["starts"], F.array(t["i"])).alias("starts"), (t["before"] - t["past"] - F.col("lead_tokens")).alias("base"))
        return F.when(over, fresh).otherwise(state)

    talks = talks.withColumn("starts", F.aggregate("turns", start, advance)["starts"])
    windows = talks.select(
        "talk", "n_lead", F.size("turns").cast("long").alias("n"), "starts", F.transform("starts", lambda s: F.get("turns", s.cast("int"))["n_past"]).alias("pasts")
    )
    windows = windows.select("talk", "n_lead", "n", "starts", "pasts", F.posexplode("starts").alias("window", "from"))
    again = F.when(F.col("window") > 0, F.least(F.get("pasts", F.col("window")), F.col("from") - F.col("n_lead"))).otherwise(0)
    windows = windows.select(
        "talk", "window", "from", F.coalesce(F.get("starts", F.col("window") + 1), F.col("n")).alias("to"), again.alias("again"),
        F.when(F.col("window") > 0, F.col("n_lead")).otherwise(0).alias("n_lead"),
    )
    # the turns of each window: the system turn, the history, its own
    own = F.sequence(F.col("from") - F.col("again"), F.col("to") - 1)
    shown = windows.select("*", F.explode(F.when(F.col("n_lead") > 0, F.concat(F.array(F.lit(0).cast("long")), own)).otherwise(own)).alias("i"))
    texts = rows.select("talk", F.col("i").cast("long").alias("i"), "role", "piece", "n_head", "n_body", F.length("piece").alias("n_piece"))
    said = shown.join(texts, ["talk", "i"])
    turn = F.struct("i", "piece", F.col("n_piece").alias("n"), "n_head", "n_body", ((F.col("role") == TARGET) & (F.col("i") >= F.col("from"))).alias("target"))
    whole = said.groupBy("talk", "window").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.first(F.col("n_lead") + F.col("again")).cast("int").alias("repeated"))
    # where each target's text begins, from the lengths of the pieces before it
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))
    masked = F.aggregate("turns", state, lambda s, t: F.struct(
        (s["at"] + t["n"]).alias("at"),
        F.when(t["target"], F.concat(s["mask"], F.array(F.struct((s["at"] + t["n_head"]).alias("start"), t["n_body"].alias("length"))))).otherwise(s["mask"]).alias("mask"),
    ))["mask"]
    return whole.select(
        "talk.id", "window", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("text"), "repeated", masked.alias("mask")
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """(id, n_chars, turns, targets): what the formatted windows say, each turn and target once and in order."""
    pieces = F.split("text", r"<\|end\|>")
    own = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - 1 - F.col("repeated"))
    parts = F.transform(own, lambda p: F.split(F.substring(p, len(TURN) + 1, 1 << 30), r"<\|text\|>"))
    turns = F.transform(parts, lambda p: F.struct(unescaped(p[0]).alias("role"), unescaped(p[1]).alias("text")))
    targets = F.transform("mask", lambda m: unescaped(F.substring(F.col("text"), m["start"] + 1, m["length"])))
    told = windows.select("id", "window", F.length("text").cast("long").alias("n_chars"), turns.alias("turns"), targets.alias("targets"))
    every = F.sort_array(F.collect_list(F.struct("window", "turns", "targets")))
    told = told.groupBy("id").agg(F.sum("n_chars").alias("n_chars"), every.alias("all"))
    return told.select("id", "n_chars", F.flatten(F.col("all.turns")).alias("turns"), F.flatten(F.col("all.targets")).alias("targets"))
