"""Chat formatting in budgeted windows, in DataFrame operations only.

A conversation's turns are laid out as `<turn ROLE>TEXT</turn>` lines. Prefix sums of turn tokens cut it into
turn-aligned spans: turns whose sum before them falls into the same band belong together, a turn over LONGEST
tokens stands alone. Each further window opens with the conversation's system turn, if it has SYSTEM tokens at most,
and the last turns of the span before, as far as HISTORY turns and their token limit go. A band is as wide as the
budget less the system turn, the history's limit and one turn, so all of a window, repeated turns included, keeps to
the budget; only a window whose new turn is over LONGEST can pass it. Tokens are those of the texts, without the marks.
The loss mask covers each assistant text once: repeated turns are masked.

The windows over a conversation and its digests need it in one task; conversations are many.

Inside roles and texts a backslash, `<` and `>` are written as `\\b`, `\\l` and `\\g`, so control strings can't occur
there, and reading back is exact.

Edge cases: null roles and texts are empty; turns are ordered by turn (null first), role and text, repeated rows
stay; an empty text is a turn of one token; a null conversation id is a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a window, of a turn that may share one, of the repeated turns, of a system turn that is repeated; turns repeated at most.
BUDGET, LONGEST, HISTORY_TOKENS, SYSTEM, HISTORY = 1024, 256, 256, 256, 2
HEAD, HEAD_END, TAIL = "<turn ", ">", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(x: Column) -> Column:
    for plain, coded in ESCAPES:
        x = F.replace(x, F.lit(plain), F.lit(coded))
    return x


def unescape(x: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        x = F.replace(x, F.lit(coded), F.lit(plain))
    return x


def turn_tokens(text: Column) -> Column:
    """Four code points a token, one token at least."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def windows(turns: DataFrame, budget: int = BUDGET, longest: int = LONGEST, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS, system: int = SYSTEM) -> DataFrame:
    """conv_id, window, text, n_repeated, loss (array of start and length in code points) for turns (conv_id, turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", turn_tokens(F.col("text")))
    rows = rows.withColumns({"n": F.row_number().over(order), "before": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")})
    if budget <= longest + history_tokens + system:
        raise ValueError("the budget must hold a system turn, the history and a turn")
    is_system = (F.col("n") == 1) & (F.col("role") == "system") & (F.col("tokens") <= system)
    own = F.coalesce(F.max(F.when(is_system, F.col("tokens"))).over(Window.partitionBy("conv_id")), F.lit(0))
    rows = rows.withColumns({"band": F.floor(F.col("before") / (F.lit(budget - longest - history_tokens) - own)), "long": F.col("tokens") > longest})
    opens = (F.col("band") != F.lag("band").over(order)) | F.col("long") | F.lag("long").over(order)
    rows = rows.withColumn("opens", F.when(F.col("n") > 1, opens.cast("int")).otherwise(0))
    rows = rows.withColumn("window", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = Window.partitionBy("conv_id", "window")
    rows = rows.withColumns({"last_n": F.max("n").over(span), "last_sum": F.max(F.col("before") + F.col("tokens")).over(span)})
    rows = rows.withColumn("last_window", F.max("window").over(Window.partitionBy("conv_id")))
    recent = (F.col("n") > F.col("last_n") - history) & (F.col("last_sum") - F.col("before") <= history_tokens) & (F.col("window") < F.col("last_window"))
    place = lambda w, again: F.struct(w.cast("long").alias("window"), F.lit(again).alias("again"))
    nowhere = F.expr("CAST(array() AS array<struct<window:bigint,again:boolean>>)")
    again = F.when(is_system & (F.col("last_window") > 0), F.transform(F.sequence(F.lit(1).cast("long"), F.col("last_window")), lambda w: place(w, True))).when(~is_system & recent, F.array(place(F.col("window") + 1, True))).otherwise(nowhere)
    rows = rows.select("conv_id", "n", "role", "text", F.explode(F.concat(F.array(place(F.col("window"), False)), again)).alias("at"))
    head = F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(HEAD_END))
    target = (F.col("role") == "assistant") & ~F.col("at.again")
    piece = F.struct("n", F.col("at.again").alias("again"), target.alias("target"), head.alias("head"), escape(F.col("text")).alias("body"))
    built = rows.groupBy("conv_id", F.col("at.window").alias("window")).agg(F.sort_array(F.collect_list(piece)).alias("p"))

    def mask(s: Column, x: Column) -> Column:
        body = F.length(x["body"])
        start = s["at"] + F.length(x["head"])
        span = F.array(F.struct(start.alias("start"), body.alias("length")))
        return F.struct((start + body + len(TAIL)).alias("at"), F.when(x["target"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    zero = F.expr("named_struct('at', 0, 'spans', CAST(array() AS array<struct<start:int,length:int>>))")
    return built.select(
        "conv_id",
        "window",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(TAIL))), "").alias("text"),
        F.size(F.filter("p", lambda x: x["again"])).alias("n_repeated"),
        F.aggregate("p", zero, mask, lambda s: s["spans"]).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of role and text), loss_text of each window, from its text and mask alone; repeated turns are left out."""
    pieces = F.split("text", TAIL)
    fresh = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))
    role = lambda p: unescape(F.substring_index(F.substr(p, F.lit(len(HEAD) + 1)), HEAD_END, 1))
    text = lambda p: unescape(F.substr(p, F.locate(HEAD_END, p) + 1))
    turns = F.transform(fresh, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["length"]))), "")
    return formatted.select("conv_id", "window", turns.alias("turns"), loss.alias("loss_text"), F.length("text").cast("long").alias("chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation with the digests of what is read back from its windows."""
    back = read_back(formatted)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = F.struct("window", text.alias("turns"), "loss_text", F.size("turns").cast("long").alias("n"), "chars")
    whole = back.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("w"))
    turns, loss = F.array_join(F.col("w.turns"), ""), F.array_join(F.col("w.loss_text"), "")
    total = lambda name: F.aggregate(F.col(name), F.lit(0).cast("long"), lambda a, b: a + b)
    return whole.select(
        "conv_id", total("w.n").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), total("w.chars").alias("formatted_chars")
    )
