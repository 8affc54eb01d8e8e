"""Chat formatting in budgeted windows.

A conversation becomes windows of text.  Prefix sums of turn tokens put each turn into a window (cells of the
running total, so windows are found in parallel and always begin and end with a turn); later windows begin with
the conversation's system turn and the last turns before them, as far as ``history`` tokens go.  Only an
assistant's own turn in its own window is a target; repeated turns are masked.

A turn is written ``### role`` line feed ``text`` ``</turn>`` line feed.  Inside roles and texts the control strings and
the escape character are escaped, reversibly: ``\\`` as ``\\b``, ``</turn>`` as ``\\e``, ``### `` as ``\\h`` (and, in roles, a
line feed as ``\\l``); so the control strings of a window are those of the template.

A window holds at most ``budget`` tokens besides the system turn, unless one turn alone is longer than half of the
room.  Everything is native.  Running sums are two-level (conversation and run of turn numbers), so a conversation
with a third of all rows is worked on in many tasks.

Edge cases: null text and role are empty; turns are ordered by number (null first), then role and text; a null
conversation is one conversation; repeated rows are turns of their own; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, prefix_sums, read_table, stored

BUDGET = 2048
HISTORY = 256
CHARS_PER_TOKEN = 4
TURN_TOKENS = 4
TARGET_ROLE = "assistant"
SYSTEM_ROLE = "system"
OPEN, CLOSE = "### ", "</turn>\n"
_TEXT_ESCAPES = (("\\", "\\b"), ("</turn>", "\\e"), ("### ", "\\h"))
_ROLE_ESCAPES = (*_TEXT_ESCAPES, ("\n", "\\l"))
_RUN = 64


def _replace(value: Column, pairs) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def escape(value: Column, role: bool = False) -> Column:
    return _replace(value, _ROLE_ESCAPES if role else _TEXT_ESCAPES)


def unescape(value: Column, role: bool = False) -> Column:
    return _replace(value, [(new, old) for old, new in reversed(_ROLE_ESCAPES if role else _TEXT_ESCAPES)])


def turns(conversations: DataFrame) -> DataFrame:
    """(key, conv_id, pos, before, role, text): turns in order with the tokens before them."""
    conv = column(conversations, "conv_id", "bigint")
    rows = conversations.select(
        F.coalesce(conv.cast("string"), F.lit("none")).alias("key"), conv.alias("conv_id"), column(conversations, "turn", "bigint").alias("turn"),
        F.coalesce(column(conversations, "role", "string"), F.lit("")).alias("role"), F.coalesce(column(conversations, "text", "string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", F.ceil(F.length("text") / CHARS_PER_TOKEN) + TURN_TOKENS)
    rows = rows.withColumn("run", F.coalesce(F.floor(F.col("turn") / _RUN), F.lit(-(1 << 62)).cast("bigint"))).withColumn("one", F.lit(1))
    inside = Window.partitionBy("key", "run").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.withColumn("rank", F.row_number().over(inside)).withColumn("inner", before)
    base = prefix_sums(rows, ["key"], "run", "tokens", "base").join(prefix_sums(rows, ["key"], "run", "one", "turns_before"), ["key", "run"])
    return ranked.join(base, ["key", "run"]).select("key", "conv_id", (F.col("turns_before") + F.col("rank")).alias("pos"), (F.col("base") + F.col("inner")).alias("before"), "role", "text")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(key, conv_id, window, text, n_repeated, loss): ``loss`` lists (start, length) in characters of ``text``."""
    cell = (budget - history) // 2
    if not 0 < history < cell:
        raise ValueError("the history must be shorter than half of the rest of the budget")
    rows = stored(turns(conversations).withColumn("window", F.floor(F.col("before") / cell)), "chat-turns")
    starts = rows.groupBy("key", "window").agg(F.min("before").alias("start"))
    system = rows.filter((F.col("pos") == 1) & (F.col("role") == SYSTEM_ROLE))
    plain = rows.filter((F.col("pos") > 1) | (F.col("role") != SYSTEM_ROLE))
    parts = ["key", "conv_id", "window", "kind", "pos", "role", "text"]
    new = rows.withColumn("kind", F.lit(2)).select(*parts)
    earlier = plain.withColumn("window", F.col("window") + 1).join(starts, ["key", "window"]).filter(F.col("start") - F.col("before") <= history).withColumn("kind", F.lit(1)).select(*parts)
    kept = system.drop("window").join(starts.filter("window > 0").select("key", "window"), "key").withColumn("kind", F.lit(0)).select(*parts)
    all_parts = new.unionByName(earlier).unionByName(kept)
    head = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit("\n"))
    shown = all_parts.withColumn("head", head).withColumn("body", escape(F.col("text")))
    shown = shown.withColumn("turn_text", F.concat("head", "body", F.lit(CLOSE)))
    order = Window.partitionBy("key", "window").orderBy("kind", "pos").rowsBetween(Window.unboundedPreceding, -1)
    shown = shown.withColumn("at", F.coalesce(F.sum(F.length("turn_text")).over(order), F.lit(0)) + F.length("head"))
    target = (F.col("kind") == 2) & (F.col("role") == TARGET_ROLE)
    span = F.when(target, F.struct(F.col("at").cast("int").alias("start"), F.length("body").alias("length")))
    grouped = shown.groupBy("key", "conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("kind", "pos", "turn_text", span.alias("span")))).alias("t"), F.sum(F.when(F.col("kind") < 2, 1).otherwise(0)).cast("int").alias("n_repeated"))
    return grouped.select("key", "conv_id", "window", F.array_join(F.transform("t", lambda x: x["turn_text"]), "").alias("text"), "n_repeated",
                          F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss"))


def read_windows(formatted: DataFrame) -> DataFrame:
    """(key, conv_id, window, turns, loss_text) from the formatted text alone: the window's own turns, unescaped."""
    found = F.split("text", CLOSE)
    own = F.filter(F.slice(found, F.col("n_repeated") + 1, F.greatest(F.size(found) - F.col("n_repeated") - 1, F.lit(0))), lambda x: x != "")
    parsed = F.transform(F.transform(own, lambda x: F.split(x, "\n", 2)), lambda x: F.struct(
        unescape(F.substring(F.get(x, F.lit(0)), len(OPEN) + 1, 1 << 30), True).alias("role"), unescape(F.get(x, F.lit(1))).alias("text")))
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return formatted.select("key", "conv_id", "window", parsed.alias("turns"), F.array_join(learned, "").alias("loss_text"), F.length("text").alias("chars"))


def op9_chat_windows(spark, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table.select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_windows(stored(windows(rows), "chat-windows"))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = back.select("key", "conv_id", "window", shown.alias("shown"), F.size("turns").alias("n"), "loss_text", "chars")
    # The digests run over a whole conversation, so its text meets in one row here, and only here.
    whole = parts.groupBy("key", "conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "shown", "loss_text"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return whole.select("conv_id", "n_turns", F.sha2(joined("shown"), 256).alias("turns_sha256"), F.length(joined("loss_text")).cast("bigint").alias("loss_chars"),
                        F.sha2(joined("loss_text"), 256).alias("loss_sha256"), "formatted_chars")


QUERIES = {"op9_chat_windows": op9_chat_windows}
ORACLES: dict[str, str] = {}
