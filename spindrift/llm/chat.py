"""Chat formatting from event logs, with DataFrame functions only.

A log has one row per event: conv_id, seq, msg, kind, role, text. Events of a conversation are put in order of seq and
folded, message by message: `message` and `edit` set a message's text, `regenerate` drops it and starts anew with what
it carries, `delta` appends, `delete` removes the message. Messages keep the place of their first event. `streamed` makes
such a log of finished turns. The result is rendered as

    <|im_start|>role NEWLINE text<|im_end|> NEWLINE

for each turn. A control string inside a text is escaped by one more backslash after its `<` (`<|` becomes `<\\|`, `<\\|`
becomes `<\\\\|`), so no text can hold a control string, and taking one backslash away gives the text back. Roles are
escaped so too, and have their line ends and backslashes written as \\n and \\\\. `loss` lists where assistant texts stand in the
formatted string, in code points.

A conversation becomes one string, so its events meet in one task, as in the result; nothing else is gathered.

Cases: null texts and roles are empty; ties in seq go by kind, role and text; equal rows are turns of their own; an empty
log gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    # a backslash of the role itself is doubled: set those aside, then read line ends
    parts = F.split(unescaped(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def reconstructed(events: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's final messages, array<struct<role, text>>.

    A message's text is what its last event other than a delta sets, and all deltas after that, joined once: work grows with
    the log's length, not with its square.
    """
    event = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    messages = events.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(event)).alias("log"))

    def last(which) -> Column:
        """The number of the log's last event of this kind, from 1; 0 for none."""
        return F.array_max(F.transform("log", lambda e, i: F.when(which(e), i + 1).otherwise(0)))

    messages = messages.withColumn("set", last(lambda e: e["kind"] != "delta")).withColumn("named", last(lambda e: e["role"] != ""))
    start = F.get("log", F.col("set") - 1)
    opening = F.when(start["kind"] == "delete", F.lit("")).otherwise(F.coalesce(start["text"], F.lit("")))
    added = F.array_join(F.transform(F.slice("log", F.col("set") + 1, F.size("log")), lambda e: e["text"]), "")
    turn = F.struct(
        F.col("log")[0]["seq"].alias("first"),
        "msg",
        F.coalesce(F.get("log", F.col("named") - 1)["role"], F.lit("")).alias("role"),
        F.concat(opening, added).alias("text"),
        (F.element_at("log", -1)["kind"] != "delete").alias("there"),
    )
    turns = messages.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return turns.select("conv_id", F.transform(F.filter("turns", lambda t: t["there"]), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def rendered(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): `loss` is array<struct<start, length>> of the trained texts, as escaped, in code points.

    `conversations` has one row per conv_id.
    """
    turns = conversations.select("conv_id", F.posexplode_outer("turns").alias("n", "t"))
    parts = turns.select("conv_id", "n", F.concat(F.lit(START), _role_out(F.col("t.role")), F.lit("\n")).alias("head"), escaped(F.col("t.text")).alias("body"), (F.col("t.role") == TRAINED).alias("trained"))
    sized = parts.withColumn("size", F.length("body").cast("long")).withColumn("whole", F.length("head") + F.col("size") + len(END) + 1)
    before = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("start", F.coalesce(F.sum("whole").over(before), F.lit(0)) + F.length("head"))
    part = F.struct("n", F.concat("head", "body", F.lit(END + "\n")).alias("block"), "start", "size", "trained")
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("head").isNotNull(), part))).alias("parts"))
    loss = F.transform(F.filter("parts", lambda p: p["trained"]), lambda p: F.struct(p["start"].alias("start"), p["size"].alias("length")))
    return rows.select("conv_id", F.array_join(F.transform("parts", lambda p: p["block"]), "").alias("formatted"), loss.alias("loss"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted string, unescaped: the way back."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turn(block: Column) -> Column:
        rest = F.substring(block, F.lit(len(START) + 1), F.length(block))
        at = F.instr(rest, "\n")
        return F.struct(_role_in(F.substring(rest, F.lit(1), at - 1)).alias("role"), unescaped(F.substring(rest, at + 1, F.length(rest))).alias("text"))

    return F.transform(blocks, turn)


def masked(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, one after another.

    The string is read as four bytes a code point, so that a span is cut without counting from the start; it is made
    once, as the argument of a function.
    """

    def cut(data: Column) -> Column:
        return F.array_join(F.transform(loss, lambda s: unescaped(F.decode(F.substring(data, (s["start"] * 4 + 1).cast("int"), (s["length"] * 4).cast("int")), "UTF-32"))), "")

    return F.transform(F.array(F.encode(formatted, "UTF-32")), cut)[0]


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as a log with one `message` per row."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", F.row_number().over(order).cast("long").alias("msg"), "role", "text").select("conv_id", F.col("msg").alias("seq"), "msg", F.lit("message").alias("kind"), "role", "text")


#: Code points of a streamed piece.
PIECE = 100


def streamed(conversations: DataFrame, trained: str = TRAINED, piece: int = PIECE) -> DataFrame:
    """A table of turns as the log of a client that streams: folded, it gives the turns back.

    An answer has a first attempt in two pieces, is regenerated, and comes in deltas of `piece` code points; any other turn is
    a draft that an edit replaces; after every fourth turn a message is begun and deleted.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = conversations.select("conv_id", F.row_number().over(order).cast("long").alias("msg"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    here, gone = F.col("msg"), -F.col("msg")

    def event(msg: Column, kind: str, role: Column, text: Column) -> Column:
        return F.struct(msg.alias("msg"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    none, draft = F.lit(""), F.reverse(F.left("text", F.lit(piece)))
    pieces = F.transform(F.regexp_extract_all("text", F.lit("(?s).{1," + str(piece) + "}"), 0), lambda p: event(here, "delta", none, p))
    answer = F.concat(F.array(event(here, "message", F.col("role"), draft), event(here, "delta", none, draft), event(here, "regenerate", none, none)), pieces)
    other = F.array(event(here, "message", F.col("role"), draft), event(here, "edit", none, F.col("text")))
    taken_back = F.array(event(gone, "message", F.col("role"), draft), event(gone, "delta", none, draft), event(gone, "delete", none, none))
    log = F.concat(F.when(F.col("role") == trained, answer).otherwise(other), F.when(here % 4 == 0, taken_back).otherwise(F.slice(taken_back, 1, 0)))
    return turns.select("conv_id", "msg", F.posexplode(log).alias("n", "e")).select("conv_id", (F.shiftleft("msg", 32) + F.col("n")).alias("seq"), "e.msg", "e.kind", "e.role", "e.text")


def formatted_chats(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of a log of events."""
    return rendered(reconstructed(events))
