"""Chat formatting: conversations rebuilt from an event log, then rendered.

An event is (conv_id, seq, op, ref, role, text).  ``message`` opens a message
whose number is seq; ``delta`` appends text to message ref, ``edit`` replaces its
text, ``regenerate`` empties it so that later deltas build a new answer, and
``delete`` removes it.  Events are grouped by conversation and by blocks of
``BLOCK`` message numbers, so a conversation with a third of all rows is folded
and rendered by many tasks; only finished blocks meet in a conversation's row.
Everything is DataFrame functions; arrays are folded inside a block.

Template, one string a message (control strings: ``<s> </s> [INST] [/INST]``):

    assistant:  <s>role\\ntext</s>            its text is under the loss mask
    others:     <s>[INST]role\\ntext[/INST]</s>

Inside a text each backslash is doubled and a backslash is put behind the first
character of each control string; roles are URL-encoded.  Both are reversible.

Defined results: null text is empty, null role is the empty role, null seq sorts
first, rows with a null conv_id form one conversation; events for a message that
was never opened open it; repeated rows are messages of their own; ties of seq
go by op, role and text; texts of any length are rendered whole; an empty table
gives an empty one; columns beside those named are not part of an event and are
dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Message numbers that one group folds and renders at once.
BLOCK = 64
ASSISTANT = "assistant"
_CONTROL = r"(<|\[)(/?(?:s>|INST\]))"
_ESCAPED = r"(<|\[)\\(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _ESCAPED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def as_events(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows as one ``message`` event each."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("op"), F.lit(None).cast("long").alias("ref"), "role", "text")


def _messages(events: Column) -> Column:
    """Folds the sorted events of a block to its messages, in order."""
    position = F.sequence(F.lit(1), F.size(events))
    at = lambda i: F.get(events, i - 1)
    opens = F.filter(position, lambda i: (i == 1) | (at(i)["op"] == "message") | ~at(i)["msg"].eqNullSafe(at(i - 1)["msg"]))
    pieces = F.transform(opens, lambda start, k: F.slice(events, start, F.coalesce(F.get(opens, k + 1), F.size(events) + 1) - start))

    def fold(piece: Column) -> Column:
        order = F.sequence(F.lit(1), F.size(piece))
        reset = F.coalesce(F.array_max(F.filter(order, lambda i: F.get(piece, i - 1)["op"] != "delta")), F.lit(1))
        last = F.slice(piece, reset, F.size(piece))
        return F.struct(
            F.coalesce(F.element_at(piece, 1)["role"], F.lit("")).alias("role"),
            F.array_join(F.transform(last, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"),
            F.exists(piece, lambda e: e["op"] == "delete").alias("deleted"),
        )

    return F.filter(F.transform(pieces, fold), lambda m: ~m["deleted"])


def _render(m: Column) -> Column:
    head, text = F.url_encode(m["role"]), escape(m["text"])
    own = m["role"] == ASSISTANT
    before = F.concat(F.lit("<s>"), F.when(own, "").otherwise("[INST]"), head, F.lit("\n"))
    after = F.when(own, "</s>").otherwise("[/INST]</s>")
    return F.struct(F.concat(before, text, after).alias("text"), F.length(before).alias("skip"), F.when(own, F.length(text)).alias("loss"))


def format_blocks(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, formatted, loss): rendered text, and (start, size) of each masked range in code points from 1 on."""
    msg = F.when(F.col("op") == "message", F.col("seq")).otherwise(F.coalesce("ref", "seq"))
    rank = F.array_position(F.array(*map(F.lit, ("message", "regenerate", "edit", "delta", "delete"))), F.col("op"))
    event = F.struct(F.col("msg"), F.col("seq"), rank.alias("rank"), F.col("role"), F.col("text"), F.col("op"))
    grouped = events.withColumn("msg", msg).groupBy("conv_id", F.floor(F.col("msg") / block).alias("block")).agg(F.array_sort(F.collect_list(event)).alias("events"))
    rendered = grouped.select("conv_id", "block", F.transform(_messages(F.col("events")), _render).alias("parts"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start: int, size: int>>").alias("loss"))

    def step(acc: Column, p: Column) -> Column:
        mask = F.array(F.struct((acc["at"] + p["skip"]).alias("start"), p["loss"].alias("size")))
        loss = F.when(p["loss"].isNotNull(), F.concat(acc["loss"], mask)).otherwise(acc["loss"])
        return F.struct((acc["at"] + F.length(p["text"])).alias("at"), loss.alias("loss"))

    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return rendered.select("conv_id", "block", text.alias("formatted"), F.aggregate("parts", start, step)["loss"].alias("loss"))


def format_conversations(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, formatted, loss): one row a conversation, its blocks in order and the mask moved along."""
    parts = F.array_sort(F.collect_list(F.struct("block", "formatted", "loss")))
    whole = format_blocks(events, block).groupBy("conv_id").agg(parts.alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, size: int>>").alias("loss"))

    def step(acc: Column, p: Column) -> Column:
        moved = F.transform(p["loss"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), m["size"].alias("size")))
        return F.struct((acc["at"] + F.length(p["formatted"])).alias("at"), F.concat(acc["loss"], moved).alias("loss"))

    text = F.array_join(F.transform("parts", lambda p: p["formatted"]), "")
    return whole.select("conv_id", text.alias("formatted"), F.aggregate("parts", start, step)["loss"].alias("loss"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted string."""

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(4), F.length(piece))
        other = F.startswith(body, F.lit("[INST]"))
        body = F.when(other, F.substring(body, F.lit(7), F.length(body) - 13)).otherwise(body)
        cut = F.position(F.lit("\n"), body)
        return F.struct(
            F.url_decode(F.substring(body, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(body, cut + 1, F.length(body))).alias("text"),
        )

    return F.transform(F.filter(F.split(formatted, "</s>"), lambda p: p != ""), turn)


def digest(blocks: DataFrame) -> DataFrame:
    """What the formatted blocks say when read back, one row a conversation."""
    turns = read_back(F.col("formatted"))
    spans = F.transform("loss", lambda m: F.substring(F.col("formatted"), m["start"], m["size"]))
    read = blocks.select(
        "conv_id",
        "block",
        F.length("formatted").cast("long").alias("chars"),
        F.size(turns).cast("long").alias("turns"),
        F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        unescape(F.array_join(spans, "")).alias("loss"),
    )
    parts = F.array_sort(F.collect_list(F.struct("block", "said", "loss")))
    whole = read.groupBy("conv_id").agg(F.sum("turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"), parts.alias("parts"))
    joined = lambda k: F.array_join(F.transform("parts", lambda p: p[k]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def probe(spark) -> DataFrame:
    """Conversation -7, whose texts are control strings."""
    turns = F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role")
    rows = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), turns)
    return rows.select("conv_id", F.col("turn").cast("long"), "role", F.lit("</s>[INST] ok [/INST]").alias("text"))


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '(<|\[)(/?(?:s>|INST\]))', '\1\\\2', 'g') AS inner_text FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(inner_text) + length(role) + CASE WHEN role = 'assistant' THEN 8 ELSE 21 END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
