"""Chat formatting in budgeted windows.

Prefix sums of turn tokens place each turn on its conversation's axis; the axis is cut into windows of ``budget -
history`` tokens less those of the leading system turn, aligned to turns: a turn that crosses a cut is a window of its
own, unless it is the conversation's first. Each later window starts with the leading system turn, where there is one,
and the last turns before it that fit in ``history`` tokens and in what its own turns leave of the budget. No window of
several new turns is longer than the budget; one of a single new turn is, where that turn and the system turn alone
are. Loss spans cover the texts of the assistant's new turns only, so what is repeated is masked and each target is
learned once.

A turn is formatted as ``### role: text</turn>`` and a line break. In texts and roles ``\\``, ``#`` and ``<`` are
written ``\\b``, ``\\h`` and ``\\l`` (and ``:`` in roles ``\\c``), so no text can hold a control string, and all of it
is undone by ``unescape``.

Prefix sums are made in blocks of ``BLOCK`` turns and over the blocks' sums, and windows are bounded by their budget
and the longest turn; a conversation with a third of all rows is therefore not one task's work. Only Spark's own
functions are used.

Defined cases: a null text or role is empty; turns with equal numbers are ordered by role and text, null numbers come
first; a null conv_id is a conversation; a system turn that isn't the first is an ordinary turn; repeated rows are
turns each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import words

#: Tokens (words and ``MARKS`` a turn) of a window, and of repeated turns in it.
BUDGET, HISTORY = 512, 128
#: Tokens that a turn's marks count as.
MARKS = 4
#: Turns of a conversation that one task sums up.
BLOCK = 256

START, END = "### ", "</turn>\n"


def escape(text: Column) -> Column:
    """``text`` without backslash, number sign and less-than sign but for escapes."""
    for a, b in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    """Undoes ``escape`` (and the role's colon)."""
    for a, b in (("\\c", ":"), ("\\l", "<"), ("\\h", "#"), ("\\b", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _header(role: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit(": "))


def placed_turns(conversations: DataFrame, stride: int) -> DataFrame:
    """conv_id, role, text, n (tokens), pos (tokens before, -1 for the leading system turn), lead_n (tokens of that), stride (of the conversation) and the window v.

    ``stride``: tokens of a window's new turns where no system turn leads.
    """
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumns({"n": (F.size(words(F.col("text"))) + MARKS).cast("long"), "block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62)))})
    here = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.withColumns({"nth": F.row_number().over(here), "sum": F.sum("n").over(here.rowsBetween(Window.unboundedPreceding, 0))})
    blocks = turns.groupBy("conv_id", "block").agg(F.sum("n").alias("n_block"), F.max(F.when(F.col("nth") == 1, F.struct("role", "n"))).alias("head"))
    along = Window.partitionBy("conv_id").orderBy("block")
    blocks = blocks.select(
        F.col("conv_id").alias("b_conv"),
        F.col("block").alias("b_block"),
        (F.sum("n_block").over(along) - F.col("n_block")).alias("offset"),
        (F.row_number().over(along) == 1).alias("first_block"),
        F.first("head").over(along).alias("lead"),
    )
    turns = turns.join(blocks, turns["conv_id"].eqNullSafe(blocks["b_conv"]) & (turns["block"] == blocks["b_block"]))
    system = F.col("lead.role") == "system"
    leading = system & F.col("first_block") & (F.col("nth") == 1)
    lead_n = F.when(system, F.col("lead.n")).otherwise(0)
    pos = F.col("offset") + F.col("sum") - F.col("n") - lead_n
    turns = turns.withColumns({"pos": F.when(leading, F.lit(-1)).otherwise(pos).cast("long"), "lead_n": lead_n.cast("long"), "stride": F.greatest(F.lit(1), stride - lead_n).cast("long")})
    w = F.floor(F.col("pos") / F.col("stride"))
    v = F.when(F.col("pos") <= 0, F.lit(0)).otherwise(2 * w + F.when(F.col("pos") + F.col("n") > (w + 1) * F.col("stride"), 1).otherwise(0))
    return turns.select("conv_id", "role", "text", "n", "pos", "lead_n", "stride", v.cast("long").alias("v"))


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, loss (start and length of each span, in code points), n_turns and n_repeated (of its turns, the first ones)."""
    if not 0 <= history < budget:
        raise ValueError("history must be less than the budget")
    stride = budget - history
    turns = placed_turns(conversations, stride)
    turn = lambda kind: F.struct(F.lit(kind).alias("kind"), "pos", "role", "text").alias("turn")
    new = turns.select("conv_id", "v", turn(2))
    later = turns.filter("v > 0").groupBy(F.col("conv_id").alias("w_conv"), F.col("v").alias("w_v")).agg(F.min("pos").alias("start"), F.least(F.lit(history), F.greatest(F.lit(0), budget - F.max("lead_n") - F.sum("n"))).alias("room"))
    # repeated turns start at most `history` tokens before the window, so they are in few strides of the axis
    bucket = lambda at: F.floor(at / stride)
    near = later.withColumn("w_bucket", F.explode(F.sequence(bucket(F.greatest(F.col("start") - history, F.lit(0))), bucket(F.col("start") - 1))))
    plain = turns.filter("pos >= 0").withColumn("bucket", bucket(F.col("pos")))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["w_conv"])
    repeated = plain.join(near, same(plain, near) & (plain["bucket"] == near["w_bucket"])).filter((F.col("pos") >= F.col("start") - F.col("room")) & (F.col("pos") + F.col("n") <= F.col("start")))
    leading = turns.filter("pos = -1")
    system = leading.join(later, same(leading, later))
    members = new.unionByName(repeated.select("conv_id", F.col("w_v").alias("v"), turn(1))).unionByName(system.select("conv_id", F.col("w_v").alias("v"), turn(0)))
    grouped = members.groupBy("conv_id", "v").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    parts = grouped.withColumn("parts", F.transform("turns", lambda t: F.struct(_header(t["role"]).alias("head"), escape(t["text"]).alias("body"), ((t["kind"] == 2) & (t["role"] == "assistant")).alias("target"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def add(a: Column, p: Column) -> Column:
        body = a["at"] + F.length(p["head"])
        span = F.struct(body.alias("start"), F.length(p["body"]).alias("length"))
        return F.struct((body + F.length(p["body"]) + len(END)).alias("at"), F.when(p["target"], F.concat(a["loss"], F.array(span))).otherwise(a["loss"]).alias("loss"))

    return parts.select(
        "conv_id",
        F.col("v").alias("window"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("text"),
        F.aggregate("parts", start, add)["loss"].alias("loss"),
        F.size("turns").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["kind"] < 2)).alias("n_repeated"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text), loss_text, formatted_chars from windows alone: what is repeated is left out."""
    turns = F.slice(F.split("text", END), F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    role = lambda p: F.substring_index(p, ": ", 1)

    def parsed(p: Column) -> Column:
        head = role(p)
        return F.struct(unescape(F.substr(head, F.lit(len(START) + 1))).alias("role"), unescape(F.substr(p, F.length(head) + 3)).alias("text"))

    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substr("text", s["start"] + 1, s["length"]))), "")
    window = windows.select("conv_id", F.struct("window", F.transform(turns, parsed).alias("turns"), learned.alias("learned"), F.length("text").cast("long").alias("chars")).alias("w"))
    whole = window.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    return whole.select(
        "conv_id",
        F.flatten(F.transform("ws", lambda w: w["turns"])).alias("turns"),
        F.array_join(F.transform("ws", lambda w: w["learned"]), "").alias("loss_text"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + w["chars"]).alias("formatted_chars"),
    )
