"""Chat formatting from an event log, in DataFrame functions alone.

A log has one row for each event of a conversation: (conv_id, seq, kind, turn, role, text). Kinds:

- ``message``: turn ``turn`` has this role and text, whatever it had before;
- ``delta``: the text is appended to the turn's;
- ``edit``: the turn's text is replaced, and the turns after it go;
- ``regenerate``: as edit, with an empty text that deltas may fill.

Events are folded in the order of seq. What a turn ends as is decided by its last message, edit or
regenerate and the deltas after that, and by whether a later edit of an earlier turn removed it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN = "### "
NAMED = ": "
END = "</turn>\n"


def escape(text: Column, also: tuple[tuple[str, str], ...] = ()) -> Column:
    """The text without ``#`` and ``<``, with which the template's control strings begin.

    A backslash begins each code, and stands for itself as a code too, so unescape gives the text back.
    """
    for char, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), *also):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def _escaped_role(role: Column) -> Column:
    """A role ends at the first colon, so its own are codes too."""
    return escape(role, ((":", "\\c"),))


def unescape(text: Column) -> Column:
    for char, code in ((":", "\\c"), ("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def messages_as_events(turns: DataFrame, piece: int = 256, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the log that a chat service would have kept of it.

    A turn of a role in ``learn`` is streamed: a message opens it, a delta brings a draft (the text's latter half), a regeneration
    drops that, and deltas of ``piece`` code points bring the text. Any other turn is a message with a draft, which an edit
    replaces by the text. Turns that repeat a number are told apart by nth, in the order of role and text. Null texts are
    empty ones; extra columns are left out; an empty table gives an empty log.
    """
    some = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    again = W.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    # Dealt out by conversation at once, so that the fold needs no exchange of its own.
    some = some.repartition("conv_id").withColumn("nth", (F.row_number().over(again) - 1).cast("long"))
    text = F.coalesce("text", F.lit(""))
    draft = F.substr(text, (F.floor(F.length(text) / 2) + 1).cast("int"))

    def step(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / piece).cast("int") - 1, F.lit(0))), lambda i: step("delta", F.substr(text, i * piece + 1, F.lit(piece))))
    streamed = F.concat(F.array(step("message", F.lit("")), step("delta", draft), step("regenerate", F.lit(None).cast("string"))), pieces)
    edited = F.array(step("message", draft), step("edit", text))
    steps = F.when(F.coalesce(F.col("role").isin(*learn), F.lit(False)), streamed).otherwise(edited)
    return some.select("conv_id", "turn", "role", "nth", F.posexplode(steps).alias("part", "step")).select("conv_id", F.col("turn").alias("seq"), "step.kind", "turn", "role", "step.text", "nth", F.col("part").cast("long").alias("part"))


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, turns: array<struct<role, text>>) of each conversation of the log.

    Ties in seq are ordered by turn, nth, part, kind, role and text. Null roles and texts count as empty, null turns and seqs as
    least, null kinds as message. nth and part may be absent and count as 0 where null: turns of one number but another nth are
    turns of their own, in the order of nth. An edit, regenerate or delta of a turn that is not there makes it, with
    the role of the event. All conversations of null id are one. Extra columns are not read. An empty log gives an empty table.

    Events of the last turn or a later one are folded without a look at the turns before it; only those of an
    earlier turn go through the turns.
    """
    extra = {c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) if c in events.columns else F.lit(0).cast("long") for c in ("nth", "part")}
    event = F.struct(
        F.coalesce("seq", F.lit(-(1 << 62))).cast("long").alias("seq"),
        F.coalesce("turn", F.lit(-(1 << 62))).cast("long").alias("turn"),
        extra["nth"].alias("nth"),
        extra["part"].alias("part"),
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    logs = events.groupBy("conv_id").agg(F.array_sort(F.collect_list(event)).alias("log"))
    turn = "struct<key: struct<turn: bigint, nth: bigint>, role: string, parts: array<string>>"
    none = F.struct(F.array().cast(f"array<{turn}>").alias("turns"), F.lit(None).cast(turn).alias("top"))

    def fold(state: Column, e: Column) -> Column:
        turns, top = state["turns"], state["top"]  # top: the turn of the greatest key
        key = F.struct(e["turn"].alias("turn"), e["nth"].alias("nth"))
        old = F.get(F.filter(turns, lambda t: t["key"] == key), F.lit(0))
        fresh = F.array(F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"]))

        def made(was: Column) -> Column:
            role = F.when((e["kind"] == "message") | was.isNull(), e["role"]).otherwise(was["role"])
            parts = F.when((e["kind"] == "delta") & was.isNotNull(), F.concat(was["parts"], F.array(e["text"]))).otherwise(fresh)
            return F.struct(key.alias("key"), role.alias("role"), parts.alias("parts"))

        def then(turns: Column, top: Column) -> Column:
            return F.struct(turns.alias("turns"), top.alias("top"))

        return (
            F.when(top.isNull(), then(turns, made(F.lit(None).cast(turn))))
            .when(key > top["key"], then(F.concat(turns, F.array(top)), made(F.lit(None).cast(turn))))
            .when(key == top["key"], then(turns, made(top)))
            .when(e["kind"].isin("edit", "regenerate"), then(F.filter(turns, lambda t: t["key"] < key), made(old)))
            .otherwise(then(F.concat(F.filter(turns, lambda t: t["key"] != key), F.array(made(old))), top))
        )

    every = F.aggregate("log", none, fold, lambda s: F.array_sort(F.concat(s["turns"], F.array(s["top"]))))
    return logs.select("conv_id", F.transform(every, lambda t: F.struct(t["role"].alias("role"), F.array_join(t["parts"], "").alias("text"))).alias("turns"))


def render(conversations: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, n_turns and loss_spans for conversations of (conv_id, turns).

    loss_spans are the stretches (start, length, in code points) of ``formatted`` that carry loss: the
    escaped texts of the roles in ``learn``. They are the template's to know; ``read_back`` needs neither.
    """
    piece = F.transform("turns", lambda t: F.struct(t["role"].isin(*learn).alias("loss"), F.concat(F.lit(TURN), _escaped_role(t["role"]), F.lit(NAMED)).alias("head"), escape(t["text"]).alias("body")))
    with_pieces = conversations.select("conv_id", piece.alias("pieces"))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    lengths = F.transform("pieces", lambda p: F.struct(p["loss"].alias("loss"), F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        at = state["at"] + p["head"]
        span = F.struct(at.alias("start"), p["body"].cast("long").alias("length"))
        return F.struct((at + p["body"] + len(END)).alias("at"), F.when(p["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate(lengths, start, step, lambda s: s["spans"])
    return with_pieces.select("conv_id", formatted.alias("formatted"), F.size("pieces").cast("long").alias("n_turns"), spans.alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans and turns as the formatted text alone tells them."""
    parts = F.split("formatted", "</turn>\\n")
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), NAMED, 1)).alias("role"), unescape(F.substr(p, F.instr(p, NAMED) + len(NAMED))).alias("text")))
    return rendered.select("conv_id", "formatted", "loss_spans", turns.alias("turns"))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
