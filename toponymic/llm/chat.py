"""Chat formatting: final messages folded from a log of events, rendered with a loss mask.

Only DataFrame functions are used, so everything runs inside the JVM.

Log: one row per event of a conversation, ``conv_id``, ``seq`` (order of the events),
``message`` (place of the message that the event is about), ``event``, ``role``, ``text``:

- ``message``     the message, whole; starts it anew if it was there;
- ``delta``       text that is appended to the message;
- ``edit``        text that takes the place of all that the message holds;
- ``regenerate``  the message begins anew, with the text of this event if it has one; what earlier events said about later messages is void.

``fold`` groups the events of a message (so a conversation with very many events is shared
by many tasks), voids what a regeneration of an earlier message cut off (a running maximum
over the conversation's messages), takes what stands from the last event that starts the
message on, and joins its text. ``render`` joins a conversation's messages in order:

    <turn ROLE>
    TEXT
    </turn>

ROLE is URL-encoded. In TEXT, ``<turn`` and ``</turn``, with any backslashes in front of
them, get one more backslash; nothing else is changed. A mark of the template stands
behind a line feed or at the start, so it never has a backslash in front, and taking one
backslash away gives the text back. The loss mask lists the byte ranges (UTF-8) of the
assistant texts in the output.

Defined cases: null texts and roles are empty; an event that is null or of another kind changes
nothing; events that are equal in all columns count once (logs are delivered at least once),
others with the same number are taken in the order of kind, role, text; null numbers
come first. The role is the last one given by an event that isn't void. A message whose events are all void
is no turn; a conversation without turns gives no row. Rows without ``conv_id`` are one
conversation without an id. Other columns of any name are not looked at; an empty log gives no rows.
A conversation is one row of the output, so its formatted text can have 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STARTS = ("message", "edit", "regenerate")
EVENTS = (*STARTS, "delta")
ASSISTANT = "assistant"

# What is escaped: a mark with the backslashes in front. Each run of backslashes is read once.
_MARK = r"(?<!\\)(\\*+</?turn)"
_ESCAPED = r"(?<!\\)\\(\\*+</?turn)"
_END = r"(?<!\\)</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _MARK, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def fold(log: DataFrame) -> DataFrame:
    """``conv_id``, ``message``, ``role``, ``text``: the messages that are left, one row each."""
    events = log.select(
        "conv_id", F.col("message").cast("long").alias("message"),
        F.struct(F.col("seq").cast("long").alias("seq"), "event", "role", F.coalesce("text", F.lit("")).alias("text")).alias("e"),
    ).where(F.col("e.event").isin(*EVENTS))
    # structs compare field by field, so the array is in the order of the numbers, ties by kind, role and text
    held = events.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_set("e")).alias("e"),
        F.max(F.when(F.col("e.event") == "regenerate", F.col("e.seq"))).alias("again"))
    earlier = (Window.partitionBy("conv_id").orderBy("message")
                     .rowsBetween(Window.unboundedPreceding, -1))
    valid = F.filter("e", lambda x: F.col("cut").isNull() | (x["seq"] > F.col("cut")))
    left = (held.withColumn("cut", F.max("again").over(earlier))
                .select("conv_id", "message", valid.alias("e")).where(F.size("e") > 0))
    # the last start: one past its distance from the end, or the first event where there is none
    back = F.array_position(F.reverse(F.transform("e", lambda x: x["event"].isin(*STARTS))), F.lit(True))
    since = F.slice("e", F.when(back > 0, F.size("e") - back.cast("int") + 1).otherwise(F.lit(1)), F.size("e"))
    roles = F.filter(F.transform("e", lambda x: x["role"]), lambda r: r.isNotNull())
    return left.select("conv_id", "message", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
                       F.array_join(F.transform(since, lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted``, ``loss`` (array of start and end, in bytes) of every conversation."""
    head = F.concat(F.lit("<turn "), F.url_encode("role"), F.lit(">\n"))
    parts = messages.select("conv_id", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    bytes_ = F.octet_length("head").cast("long") + F.octet_length("body") + len("\n</turn>\n")
    so_far = (Window.partitionBy("conv_id").orderBy("message")
                    .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = parts.withColumn("bytes", bytes_).withColumn("stop", F.sum("bytes").over(so_far))
    start = F.col("stop") - F.col("bytes") + F.octet_length("head")
    turn = F.struct("message", F.concat("head", "body", F.lit("\n</turn>\n")).alias("piece"),
                    (F.col("role") == ASSISTANT).alias("learn"), start.alias("start"),
                    (start + F.octet_length("body")).alias("end"))
    turns = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    loss = F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["start"], x["end"]))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
                        loss.cast("array<struct<start:bigint,end:bigint>>").alias("loss"))


def format_log(log: DataFrame) -> DataFrame:
    """Formatted text and loss mask of every conversation of a log."""
    return render(fold(log))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    def turn(piece: Column) -> Column:
        at = F.instr(piece, ">\n")                              # the encoded role holds neither
        role = F.substr(piece, F.lit(len("<turn ") + 1), at - F.lit(len("<turn ") + 1))
        text = F.substr(piece, at + F.lit(2), F.char_length(piece) - at - F.lit(2))
        return F.struct(F.url_decode(role).alias("role"), unescape(text).alias("text"))

    # behind the last end mark nothing is left; the line feed in front of a mark belongs to the template
    pieces = F.split(formatted, _END)
    return F.transform(F.filter(pieces, lambda p: p != ""), turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    # one copy of the bytes, from which every range is cut, so the cost follows the text and not its square
    cut = lambda b: F.array_join(F.transform(
        loss, lambda s: unescape(F.decode(F.substring(b, s["start"] + 1, s["end"] - s["start"]), "UTF-8"))), "")
    return F.transform(F.array(formatted.cast("binary")), cut)[0]


def logged(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) in the form of an event log.

    A turn of an assistant appears as a stream: a first attempt, its regeneration, then the text in deltas
    of three parts; any other as a message with a slip, and its edit. Rows of a
    conversation with the same turn are turns of their own, by role and text.
    """
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("message", F.row_number().over(order).cast("long"))
    third = F.ceil(F.char_length("text") / 3).cast("int")
    part = lambda i: F.substr("text", third * F.lit(i) + 1, third)      # noqa: E731
    event = lambda i, kind, text, role=F.lit(None): F.struct(           # noqa: E731
        F.lit(i).alias("i"), F.lit(kind).alias("event"), role.cast("string").alias("role"), text.alias("text"))
    stream = F.array(event(0, "delta", F.reverse("text"), F.col("role")), event(1, "regenerate", F.lit("")),
                     *(event(2 + i, "delta", part(i)) for i in range(3)))
    typed = F.array(event(0, "message", F.upper("text"), F.col("role")), event(1, "edit", F.col("text")))
    out = rows.select("conv_id", "message",
                      F.explode(F.when(F.col("role") == ASSISTANT, stream).otherwise(typed)).alias("x"))
    return out.select("conv_id", (F.col("message") * 8 + F.col("x.i")).alias("seq"), "message",
                      F.col("x.event").alias("event"), F.col("x.role").alias("role"), F.col("x.text").alias("text"))
