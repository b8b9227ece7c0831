"""Chat formatting in budgeted windows (operator 2, DataFrame functions only).

Turns get a token estimate; its prefix sums over a conversation choose spans of whole turns.  A
window is the conversation's first system turn, the last turns of the span before as far as they
fit the history budget, and the span itself.  Only assistant texts of the span itself are targets:
repeated turns are masked.  Prefix sums are built in two levels (blocks of turns, then blocks of a
conversation), so a conversation with very many turns is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemill.llm.common import stored

#: Tokens of a window, those of them for repeated history, and the least left for new turns.
BUDGET, HISTORY, LEAST_SPAN = 2048, 256, 512
#: Turn numbers per block of the two-level prefix sums.
BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TARGET_ROLE = "assistant"


def byte_tokens(text: Column) -> Column:
    """The default estimate: a token per four UTF-8 bytes, begun ones counted, and four for the marks of a turn."""
    return (F.ceil(F.octet_length(text) / 4) + 4).cast("long")


def escape(text: Column) -> Column:
    """Put one more backslash into every ``<``, backslashes, ``|``: no control string is left, and nothing is lost."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles also lose line ends: backslash and line feed become two characters each."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Undo ``escape_role``: backslash pairs are set aside while line feeds return."""
    pairs = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(pairs, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def windows(
    turns: DataFrame, tokens: Callable[[Column], Column] = byte_tokens,
    budget: int = BUDGET, history: int = HISTORY, least_span: int = LEAST_SPAN, block: int = BLOCK,
) -> DataFrame:
    """One row per window: conv_id, begin, formatted, repeated, starts, ends.

    ``begin`` (tokens before its first new turn) orders a conversation's windows; ``starts`` and ``ends`` are the code point spans of the targets in ``formatted``; the first
    ``repeated`` turns are the system turn and history.  Input: conv_id, turn, role, text, one row
    per turn; null roles and texts count as empty; a null conv_id is a conversation, null turns
    come last; rows with the same turn are ordered by role and text; repeated rows are turns like
    any other.  No turn is cut: one that exceeds half a span stands alone, whatever its length.
    An empty table gives no windows; other columns are ignored.
    """
    place = F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text")
    sized = (
        turns.select(
            "conv_id", F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        )
        .withColumn("tokens", tokens(F.col("text")))
        .withColumn("block", F.floor(F.col("turn") / block))
    )
    # per conversation: its first system turn, and half of what that leaves for new turns
    heads = stored(
        sized.groupBy(F.col("conv_id").alias("head_id"))
        .agg(F.min(F.when(F.col("role") == "system", F.struct(place.alias("place"), "tokens"))).alias("system"))
        .select(
            "head_id", F.col("system.place").alias("system"),
            F.floor(
                F.greatest(F.lit(least_span), F.lit(budget - history) - F.coalesce("system.tokens", F.lit(0))) / 2
            ).alias("half"),
        ),
        "chat-heads",
    )
    known = sized.join(heads.select("head_id", "half"), F.col("conv_id").eqNullSafe(F.col("head_id"))).drop("head_id")
    known = stored(known.withColumn("long", (F.col("tokens") > F.col("half")).cast("long")), "chat-turns")
    # level 1: blocks of a conversation
    by_block = known.groupBy("conv_id", "block").agg(
        F.sum("tokens").alias("block_tokens"), F.sum("long").alias("block_long"),
        F.max(F.struct(place.alias("place"), "tokens", "long")).alias("final"),
    )
    over = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("block"))
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    bases = by_block.select(
        F.col("conv_id").alias("base_id"), F.col("block").alias("base_block"),
        F.coalesce(F.sum("block_tokens").over(earlier), F.lit(0)).alias("base_tokens"),
        F.coalesce(F.sum("block_long").over(earlier), F.lit(0)).alias("base_long"),
        F.lag("final.tokens").over(over).alias("prev_tokens"), F.lag("final.long").over(over).alias("prev_long"),
    )
    # level 2: turns of a block
    placed = known.join(
        bases, F.col("conv_id").eqNullSafe(F.col("base_id")) & F.col("block").eqNullSafe(F.col("base_block"))
    )
    within = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_last("turn"), "role", "text")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    begun = placed.select(
        "conv_id", "turn", "role", "text", "tokens", "long", "half",
        (F.col("base_tokens") + F.coalesce(F.sum("tokens").over(before), F.lit(0))).alias("begin"),
        (F.col("base_long") + F.coalesce(F.sum("long").over(before), F.lit(0))).alias("longs"),
        F.coalesce(F.lag("tokens").over(within), "prev_tokens").alias("last_tokens"),
        F.coalesce(F.lag("long").over(within), "prev_long").alias("last_long"),
    )

    def span(begin: Column, longs: Column, is_long: Column) -> Column:
        """Turns that begin in the same half span, after the same long turns; a long turn alone."""
        return F.concat_ws(":", longs, is_long, F.floor(begin / F.col("half")))

    spanned = stored(
        begun.withColumn("span", span(F.col("begin"), F.col("longs"), F.col("long"))).withColumn(
            "last_span",
            F.when(
                F.col("last_tokens").isNotNull(),
                span(F.col("begin") - F.col("last_tokens"), F.col("longs") - F.col("last_long"), F.col("last_long")),
            ),
        ),
        "chat-spans",
    )
    fresh = spanned.select("conv_id", "span", F.lit(2).alias("kind"), "begin", "turn", "role", "text")
    # history: the last turns of a span as far as they fit, repeated in the span that follows
    follows = spanned.where("last_span is not null and last_span <> span").select(
        F.col("conv_id").alias("next_id"), F.col("last_span"), F.col("span").alias("next_span")
    )
    whole = Window.partitionBy("conv_id", "span")
    systems = heads.select(F.col("head_id").alias("system_id"), "system").where("system is not null")
    of_system = F.col("conv_id").eqNullSafe(F.col("system_id"))
    tail = (
        spanned.withColumn("end", F.max(F.col("begin") + F.col("tokens")).over(whole))
        .where(F.col("end") - F.col("begin") <= history)
        .drop("last_span")
        .join(follows, F.col("conv_id").eqNullSafe(F.col("next_id")) & (F.col("span") == F.col("last_span")))
        .join(systems, of_system, "left")
        .where(F.col("system").isNull() | (place != F.col("system")))
        .select("conv_id", F.col("next_span").alias("span"), F.lit(1).alias("kind"), "begin", "turn", "role", "text")
    )
    # the system turn: repeated in every span that begins after it
    leading = (
        spanned.groupBy("conv_id", "span").agg(F.min(place).alias("first")).join(systems, of_system)
        .where(F.col("first") > F.col("system"))
        .select("conv_id", "span", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("begin"), "system.turn", "system.role", "system.text")
    )
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    order = whole.orderBy("kind", "begin")
    formatted = F.concat("head", "body", F.lit(CLOSE + "\n"))
    target = (F.col("kind") == 2) & (F.col("role") == TARGET_ROLE)
    laid = (
        fresh.unionByName(tail).unionByName(leading)
        .withColumn("head", head).withColumn("body", body).withColumn("formatted", formatted)
        .withColumn(
            "start",
            F.coalesce(F.sum(F.char_length("formatted")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            + F.char_length("head"),
        )
        .withColumn("end", F.col("start") + F.char_length("body"))
    )
    rows = F.array_sort(F.collect_list(F.struct("kind", "begin", "formatted", "start", "end", target.alias("target"))))
    gathered = laid.groupBy("conv_id", "span").agg(
        rows.alias("rows"), F.min(F.when(F.col("kind") == 2, F.col("begin"))).alias("begin")
    )
    targets = F.filter("rows", lambda r: r["target"])
    return gathered.select(
        "conv_id", "begin",
        F.array_join(F.transform("rows", lambda r: r["formatted"]), "").alias("formatted"),
        F.size(F.filter("rows", lambda r: r["kind"] < 2)).alias("repeated"),
        F.transform(targets, lambda r: r["start"]).alias("starts"),
        F.transform(targets, lambda r: r["end"]).alias("ends"),
    )


def read_back(windows: DataFrame, gather: int = 1 << 16) -> DataFrame:
    """Per conversation what its windows hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are parsed from the formatted texts, skipping the repeated ones, and target texts are cut
    out by their spans; both are unescaped.  A digest needs the whole conversation in order: windows
    are first joined in stretches of ``gather`` tokens, then the stretches of a conversation.
    """
    pieces = F.split("formatted", r"<\|im_start\|>", -1)
    turns = F.slice(pieces, F.col("repeated") + 2, F.greatest(F.size(pieces) - 1 - F.col("repeated"), F.lit(0)))
    close = len(CLOSE) + 1

    def canonical(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        skip = F.char_length(role) + 1
        text = F.substring(piece, skip + 1, F.char_length(piece) - skip - close)
        return F.concat(unescape_role(role), F.lit("\n"), unescape(text), F.lit("\n"))

    def target(span: Column) -> Column:
        return unescape(F.substring(F.col("formatted"), (span["starts"] + 1).cast("int"), (span["ends"] - span["starts"]).cast("int")))

    read = windows.select(
        "conv_id", "begin", F.size(turns).cast("long").alias("n_turns"),
        F.array_join(F.transform(turns, canonical), "").alias("turns"),
        F.array_join(F.transform(F.arrays_zip("starts", "ends"), target), "").alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
    )

    def joined(rows: DataFrame, *keys: Column) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct("begin", "turns", "loss")))
        return rows.groupBy("conv_id", *keys).agg(
            F.min("begin").alias("begin"), F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("chars"), listed.alias("rows")
        ).select(
            "conv_id", "begin", "n_turns", "chars",
            F.array_join(F.transform("rows", lambda r: r["turns"]), "").alias("turns"),
            F.array_join(F.transform("rows", lambda r: r["loss"]), "").alias("loss"),
        )

    whole = joined(joined(read, F.floor(F.col("begin") / gather).alias("stretch")))
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )
