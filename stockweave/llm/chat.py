"""Chat formatting from event logs, in DataFrame operations only.

A log has events ``(conversation, sequence, message, kind, role, text)``; messages are
numbered in the order of their conversation.  Kinds:

* ``delta`` appends its text to the message, which it begins if there is none;
* ``edit`` puts its text in place of what the message has so far;
* ``regenerate`` throws away what the message has so far; deltas that follow build
  it anew.

An event that is delivered twice, equal in all columns, counts once.

:func:`messages` folds a log.  A message's events are sorted by sequence; what
counts is the last edit or regeneration and all deltas after it, so the final text
is one concatenation, however many events there were.  Events are dealt out by
conversation once; folding, rendering and putting conversations together need no
other shuffle, since each of them groups by the conversation first.

:func:`render` writes each conversation by the template

    ### role: text</turn>

with one line for the mark at each turn's end.  Inside texts and roles control strings
are broken by a backslash: ``\\`` becomes ``\\\\``, ``##`` becomes ``#\\#``, ``</turn>``
becomes ``<\\/turn>``, and in roles ``: `` becomes ``:\\ ``.  So a control string in the
output is always one of the template, and taking each backslash off what follows it
undoes the escape.  The loss mask lists the spans of the escaped texts of the roles to
learn from: the turn, where in that turn and where in the whole output the span
begins, and its length, all in code points.

:func:`read_back` parses outputs by the template's control strings.

Edge cases.  Null texts and roles are empty.  Events without a conversation are one
conversation without an id.  A null message number sorts first, a null sequence
before all others; events of one sequence sort by kind, role and text.  A null or
unknown kind is a delta.  The role is the last one named.  A conversation is one
row, so it has to fit in one value (2 GB); no task holds more than one conversation
beyond that.  An empty log gives none.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEAD, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
LEARN = ("assistant",)


def escape(text: Column) -> Column:
    """Control strings broken by backslashes; reversible."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.regexp_replace(doubled, "#(?=#)", r"#\\"), F.lit("</turn>"), F.lit("<\\/turn>"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(AFTER_ROLE), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    """What a backslash stands before, without it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def messages(log: DataFrame) -> DataFrame:
    """``conversation, message, role, text``: the final messages of a log."""
    event = F.struct("sequence", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = log.repartition("conversation")  # a conversation's events, wherever they were
    folded = dealt.groupBy("conversation", "message").agg(F.sort_array(F.collect_set(event)).alias("events"))
    # From the last event on that throws away what was before it.
    last = F.expr("coalesce(array_max(transform(events, (e, i) -> IF(e.kind IN ('edit', 'regenerate'), i + 1, 1))), 1)")
    counted = folded.select("conversation", "message", "events", last.alias("last"))
    role = F.expr("coalesce(try_element_at(filter(events, e -> e.role <> ''), -1).role, '')")
    # A regeneration's own text, if it has any, isn't part of the message.
    text = F.expr("array_join(transform(filter(slice(events, last, size(events)), e -> e.kind <> 'regenerate'), e -> e.text), '')")
    return counted.select("conversation", "message", role.alias("role"), text.alias("text"))


def render(final: DataFrame, learn: tuple[str, ...] = LEARN) -> DataFrame:
    """``conversation, formatted, loss``: one row a conversation.

    ``loss`` is an array of ``(turn, at, start, length)``: the span begins ``at`` in the
    turn and ``start`` in the whole output."""
    head = F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(AFTER_ROLE))
    turn = final.select("conversation", "message", F.col("role").isin(*learn).alias("learned"), head.alias("head"), escape(F.col("text")).alias("body"))
    turn = turn.withColumn("at", F.length("head")).withColumn("length", F.length("body"))
    before = Window.partitionBy("conversation").orderBy(F.asc_nulls_first("message")).rowsBetween(Window.unboundedPreceding, -1)
    turn = turn.withColumn("turn", F.count(F.lit(1)).over(before).cast("int"))
    turn = turn.withColumn("start", F.coalesce(F.sum(F.col("at") + F.col("length") + len(END)).over(before), F.lit(0)) + F.col("at"))
    piece = F.struct("turn", "learned", "at", "start", "length", F.concat("head", "body", F.lit(END)).alias("piece"))
    whole = turn.groupBy("conversation").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["turn"].alias("turn"), t["at"].alias("at"), t["start"].alias("start"), t["length"].alias("length")))
    return whole.select("conversation", F.array_join("turns.piece", "").alias("formatted"), spans.alias("loss"))


def format_chats(log: DataFrame, learn: tuple[str, ...] = LEARN) -> DataFrame:
    return render(messages(log), learn)


def read_back(done: DataFrame) -> DataFrame:
    """``conversation, turns, learned, formatted``: the turns ``(role, text)`` that an output
    holds, and the unescaped texts under the loss mask."""
    # The mark at the end of the last turn leaves one empty piece.
    pieces = done.withColumn("pieces", F.split("formatted", END)).withColumn("pieces", F.expr("slice(pieces, 1, size(pieces) - 1)"))
    bare = lambda p: F.substr(p, F.lit(len(HEAD) + 1))
    role = lambda p: F.substring_index(bare(p), AFTER_ROLE, 1)
    text = lambda p: F.substr(bare(p), F.length(role(p)) + len(AFTER_ROLE) + 1)
    turns = F.transform("pieces", lambda p: F.struct(unescape(role(p)).alias("role"), unescape(text(p)).alias("text")))
    under = F.transform("loss", lambda s: unescape(F.substr(F.get(F.col("pieces"), s["turn"]), s["at"] + 1, s["length"])))
    return pieces.select("conversation", turns.alias("turns"), under.alias("learned"), "formatted")


def digests(done: DataFrame) -> DataFrame:
    """Counts and hashes of what is read back from the outputs."""
    back = read_back(done)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.select("conversation", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.array_join("learned", "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select(
        F.col("conversation").alias("conv_id"), "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def log_of_conversations(rows: DataFrame) -> DataFrame:
    """A log whose final messages are the rows of a table ``(conv_id, turn, role, text)``.

    An assistant's text is streamed in three deltas after a first answer that is
    regenerated; others' texts are sent in part and edited when the conversation is
    over.  Rows of one turn are messages of their own, ordered by role and text."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    numbered = rows.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("message"))
    third = F.expr("CAST(length(text) DIV 3 AS INT)")
    piece = lambda i: F.substr("text", i * third + 1, third) if i < 2 else F.substr("text", 2 * third + 1)
    event = lambda at, kind, text: F.struct(at.alias("sequence"), F.lit(kind).alias("kind"), text.alias("text"))
    step = 8 * F.col("message")
    streamed = F.array(event(step, "delta", F.lit("Let me see")), event(step + 1, "regenerate", F.lit("")), *[event(step + 2 + i, "delta", piece(i)) for i in range(3)])
    edited = F.array(event(step, "delta", piece(0)), event(step + (1 << 40), "edit", F.col("text")))
    events = numbered.withColumn("event", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)))
    return events.select(F.col("conv_id").alias("conversation"), "event.sequence", "message", "event.kind", "role", "event.text")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user and an assistant who say the template's control strings."""
    text = F.lit("\\### Assistant: </turn> ok")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
