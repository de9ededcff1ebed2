"""Chat formatting by event-sourced reconstruction (operator 3).

A log holds events of messages: ``message`` (the whole text), ``delta`` (text to append), ``edit`` (the whole text anew) and
``regenerate`` (the text starts anew, and all messages that began after this one and before the event are taken back). An event's place is a pair (seq, part). Reconstruction runs
in two sorted folds, neither of which holds more than a message at a time:

1. a message's events in order of sequence: its final text, where it began, and its last regeneration. A conversation's log is dealt by
   message here, so that one of a third of all events is many tasks' work;
2. a conversation's messages in order of where they began: a message is taken back if it began before the last regeneration of a message
   that stands and began earlier. That needs one place for each conversation.

What stands is rendered a turn at a time with the span that counts for the loss, so that a conversation's length doesn't matter. A digest of a whole conversation is a chain over
its turns in order: one conversation is read by one task, as a stream.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.runtime import arrow_map

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("message", "delta", "edit", "regenerate")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n([^<]*(?:<(?!\|)[^<]*)*)<\|im_end\|>\n")


def escape(text: str) -> str:
    """The text without control strings: one more backslash between each < and | that stand together or have backslashes between them."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted string; ValueError if it isn't made of turns."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def events_of(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A log that gives back a table of turns: conv, seq, part, msg, kind, role, text. Every row is a message of its own, told by its turn and its place among the rows of that turn.

    Texts are streamed in deltas. One message in four starts as a draft that is edited; one in four, of those that are alone in their turn, is a draft that a user
    answers and that is generated anew, which takes the answer back. Which do so is a hash's matter, so that a task that runs again tells the same.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("seq"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    same = Window.partitionBy("conv", "seq")
    rows = rows.withColumns({"place": F.row_number().over(same.orderBy("role", "text")), "many": F.count("*").over(same)})
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    pieces = [F.substring("text", F.lit(1), third), F.substring("text", third + 1, third), F.substring("text", 2 * third + 1, n)]
    draft = F.concat(F.lit("draft of "), pieces[1])

    def event(part: int, kind: str, text: Column, role: Column | None = None, place: Column | None = None) -> Column:
        msg = F.struct(F.col("seq").alias("turn"), (F.col("place") if place is None else place).cast("int").alias("place"))
        return F.struct(F.lit(part).alias("part"), msg.alias("msg"), F.lit(kind).alias("kind"), (F.col("role") if role is None else role).alias("role"), text.alias("text"))

    streamed = F.array(event(0, "message", pieces[0]), event(1, "delta", pieces[1]), event(2, "delta", pieces[2]))
    edited = F.array(event(0, "message", pieces[0]), event(1, "delta", draft), event(5, "edit", F.col("text")))
    answer = event(4, "message", F.lit("an answer to the draft"), F.lit("user"), F.lit(0))
    anew = F.array(event(0, "message", draft), event(1, "delta", pieces[0]), answer, event(6, "regenerate", pieces[0]), event(7, "delta", pieces[1]), event(8, "delta", pieces[2]))
    pick = F.pmod(F.xxhash64("conv", "seq", "role", "text", "place"), F.lit(4))
    told = F.when(pick == 0, edited).when((pick == 1) & (F.col("many") == 1) & F.col("seq").isNotNull(), anew).otherwise(streamed)
    return rows.select("conv", "seq", F.explode(told).alias("e")).select("conv", "seq", "e.*")


def messages(events: DataFrame) -> DataFrame:
    """(conv, began, msg, role, text) of the messages that stand at the log's end. events: conv, seq, part, msg, kind, role, text; began is (seq, part).

    A null text is empty, a null role is that of the message's other events, else empty; null conv and msg are values like any other, a null seq comes first; events of an unknown kind raise
    ValueError. Events of one message and place are taken in order of kind and text, so that ties don't depend on the run.
    """
    log = events.select("conv", "msg", F.col("seq").cast("long").alias("seq"), F.col("part").cast("int").alias("part"), "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    dealt = log.repartition("conv", "msg").sortWithinPartitions("conv", "msg", "seq", "part", "kind", "text")
    place = T.StructType([T.StructField("seq", T.LongType()), T.StructField("part", T.IntegerType())])
    out = T.StructType([T.StructField("conv", events.schema["conv"].dataType), T.StructField("began", place), T.StructField("msg", events.schema["msg"].dataType), T.StructField("redone", place), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def fold(batches):
        key, state, done = None, None, []

        def take() -> dict:
            cols = {"conv": [r[0] for r in done], "msg": [r[1] for r in done], "began": [r[2] for r in done], "redone": [r[3] for r in done], "role": [r[4] or "" for r in done], "text": ["".join(r[5]) for r in done]}
            done.clear()
            return cols

        for b in batches:
            for conv, msg, seq, part, kind, role, text in zip(*[b.column(i).to_pylist() for i in range(7)], strict=True):
                if kind not in KINDS:
                    raise ValueError(f"unknown kind of event: {kind}")
                at = {"seq": seq, "part": part}
                if state is None or (conv, msg) != key:
                    if state is not None:
                        done.append(state)
                    key, state = (conv, msg), [conv, msg, at, None, role, []]
                if kind != "delta":
                    state[5] = []
                if kind == "regenerate":
                    state[3] = at
                state[4] = role if role is not None else state[4]
                state[5].append(text)
            yield take()
        if state is not None:
            done.append(state)
            yield take()

    return _standing(arrow_map(dealt, fold, out))


def _standing(folded: DataFrame) -> DataFrame:
    order = ["conv", "began", "msg"]
    dealt = folded.repartition("conv").sortWithinPartitions(*order)
    key = lambda at: (at["seq"] is not None, at["seq"] or 0, at["part"] or 0)

    def sweep(batches):
        conv, last, any_yet = None, None, False
        for b in batches:
            keep = []
            for c, began, redone in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if not any_yet or c != conv:
                    conv, last, any_yet = c, None, True
                stands = last is None or last < key(began)
                keep.append(stands)
                if stands and redone is not None:
                    last = key(redone) if last is None else max(last, key(redone))
            kept = b.filter(pa.array(keep, pa.bool_()))
            yield {n: kept.column(i) for i, n in enumerate(b.schema.names)}

    return arrow_map(dealt, sweep, folded.schema).drop("redone")


def format_turns(standing: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """standing (conv, began, msg, role, text) with `formatted`, each turn as the template has it, and `loss`, the span (start, end) of its code points under the loss mask (null: none).
    A conversation's formatted text is that of its turns in order of began, msg, with nothing between."""
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*[f for f in standing.schema.fields if f.name not in ("role", "text")], T.StructField("formatted", T.StringType()), T.StructField("loss", span)])
    other = [f.name for f in schema.fields[:-2]]

    def run(batches):
        for b in batches:
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            formatted, loss = [], []
            for r, t in zip(cols["role"].to_pylist(), cols["text"].to_pylist(), strict=True):
                formatted.append(render(r or "", t or ""))
                end = len(formatted[-1]) - len(END) - 1
                loss.append({"start": end - len(escape(t or "")), "end": end} if r == loss_role else None)
            yield {**{n: cols[n] for n in other}, "formatted": formatted, "loss": loss}

    return arrow_map(standing, run, schema)


def conversation_digests(formatted: DataFrame, order: list[str]) -> DataFrame:
    """What is read back from formatted turns, by conversation: conv_id, n_turns, turns_sha256 (of role, \\n, text, \\n of each turn), loss_chars, loss_sha256 (all text under
    the loss mask, unescaped, nothing between) and formatted_chars. order: columns that order the turns of a conversation."""
    dealt = formatted.select("conv", *order, "loss", "formatted").repartition("conv").sortWithinPartitions("conv", *order, "formatted")
    schema = T.StructType([T.StructField("conv_id", formatted.schema["conv"].dataType), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def digest(batches):
        state, conv = None, None
        row = lambda: [conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]
        cols = lambda rows: {f.name: [r[k] for r in rows] for k, f in enumerate(schema.fields)}
        for b in batches:
            rows = []
            for c, span, text in zip(b.column(0).to_pylist(), *(b.column(b.num_columns - k).to_pylist() for k in (2, 1)), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        rows.append(row())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                if span is not None:
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            yield cols(rows)
        if state is not None:
            yield cols([row()])

    return arrow_map(dealt, digest, schema)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations of a table of turns, formatted and read back: see conversation_digests.

    Null texts and roles are empty; null conversations are one conversation; turns of one number are in order of their formatted text (role, then text), null numbers come first; repeated rows are turns each; an empty table gives an
    empty one. Other columns, whatever their names, aren't read.
    """
    standing = messages(events_of(turns, conv_col, turn_col, role_col, text_col))
    return conversation_digests(format_turns(standing).withColumn("turn", F.col("began.seq")), ["turn"])
