"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events. `fold` reduces the logs to final messages with windows over them: streamed
deltas are appended, edits replace a text, a regeneration takes back a message and all that followed it. `render` walks
each conversation in order, row by row, and writes every message as one piece of the formatted text, with the span that
the loss covers; `read_back` parses pieces alone, without the messages they came from. Conversations stream through both,
so a single long one needs no memory beyond its longest message and the ids of its regenerated ones. `logs` turns finished
turns into such logs, with drafts, fragments, edits and regenerations that the fold must undo.

A template puts markers around texts by role. Markers (its control strings) inside texts are escaped: a backslash goes in
after the first character of whatever looks like one, with or without backslashes there already. Control strings hold their
first characters nowhere else, so escaped texts hold none and the escape is undone exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded

EVENTS = ("message", "delta", "edit", "regenerate", "delete")


@dataclass(frozen=True)
class Template:
    """Prefix and suffix by role; other roles use `other`, which spells the role out. Roles in `loss` are trained on."""

    roles: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    loss: frozenset[str] = frozenset({"assistant"})
    control: tuple[str, ...] = ()
    look: re.Pattern = field(init=False, repr=False, compare=False, default=None)
    escaped: re.Pattern = field(init=False, repr=False, compare=False, default=None)

    def __post_init__(self):
        heads = {c[0] for c in self.control}
        if any(len(c) < 2 or set(c[1:]) & heads or "\\" in c for c in self.control):
            raise ValueError("a control string must hold its first character, and those of the others, only at its start")
        object.__setattr__(self, "look", re.compile("|".join(re.escape(c[0]) + r"(\\*)" + re.escape(c[1:]) for c in self.control)))
        object.__setattr__(self, "escaped", re.compile("|".join(re.escape(c[0]) + r"(\\+)" + re.escape(c[1:]) for c in self.control)))

    def escape(self, text: str) -> str:
        return self.look.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[0][0] + m[0][2:], text)

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """(piece, start and end of the loss within it in code points; both 0 without loss)."""
        body = self.escape(text)
        if role in self.roles:
            before, after = self.roles[role]
        else:
            before, after = self.other[0] + self.escape(role) + self.other[1], self.other[2]
        piece = before + body + after
        return (piece, len(before), len(before) + len(body)) if role in self.loss else (piece, 0, 0)

    def parse(self, piece: str) -> tuple[str, str]:
        """(role, text) of a piece."""
        opened, middle, closed = self.other
        if piece.startswith(opened):
            cut = piece.index(middle, len(opened))
            return self.unescape(piece[len(opened) : cut]), self.unescape(piece[cut + len(middle) : len(piece) - len(closed)])
        for role, (before, after) in self.roles.items():
            if piece.startswith(before) and piece.endswith(after) and len(piece) >= len(before) + len(after):
                return role, self.unescape(piece[len(before) : len(piece) - len(after)])
        raise ValueError("not a piece of this template")


#: Turns in instruction brackets; each role's prefix begins with a control string of its own.
INSTRUCT = Template(
    roles={"user": ("<s>[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>"), "system": ("[SYS]\n", "\n[/SYS]\n")},
    other=("[ROLE]", "[TEXT]", "[/TEXT]"),
    control=("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/TEXT]"),
)


def logs(turns: DataFrame) -> DataFrame:
    """Event logs, as fold takes them, that end in turns (conv_id, turn, role, text): every row becomes a message, in order of turn, role and text.

    By its number in the conversation, a row is sent whole without an id; streamed as a message and deltas; drafted and then edited; or
    drafted, answered by a stray message, regenerated, which takes the stray one back, and streamed anew, before another stray one that is deleted.
    """
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = rows.withColumn("k", k).withColumns({"id": F.concat(F.lit("m"), F.col("k").cast("string")), "third": F.floor(F.length("text") / 3).cast("int")})
    one, two, rest = F.substring("text", F.lit(1), F.col("third")), F.substring("text", F.col("third") + 1, F.col("third")), F.substring("text", 2 * F.col("third") + 1, F.length("text"))
    own, stray, other, draft = F.col("id"), F.concat("id", F.lit("stray")), F.concat("id", F.lit("gone")), F.lit("draft")

    def log(*events: tuple) -> Column:
        return F.array(*(F.struct(F.lit(event).alias("event"), mid.alias("message_id"), text.alias("text")) for event, mid, text in events))

    none = F.lit(None).cast("string")
    made = (
        F.when(F.col("k") % 4 == 1, log(("message", own, one), ("delta", own, two), ("delta", own, rest)))
        .when(F.col("k") % 4 == 2, log(("message", own, draft), ("delta", own, draft), ("edit", own, F.col("text"))))
        .when(F.col("k") % 4 == 3, log(("message", own, draft), ("message", stray, draft), ("delta", stray, draft), ("regenerate", own, none), ("delta", own, one), ("delta", own, two), ("delta", own, rest), ("message", other, draft), ("delete", other, none)))
        .otherwise(log(("message", none, F.col("text"))))
    )
    events = rows.select("conv_id", "k", "role", F.posexplode(made).alias("j", "e"))
    return events.select("conv_id", (F.col("k") * 16 + F.col("j")).alias("seq"), "e.event", "e.message_id", "role", "e.text")


def taken_back(events: DataFrame) -> DataFrame:
    """(conv_id, after, until) of every regeneration that finds its message: what came in between at a place of its own is taken back.

    events: (conv_id, n, event, message_id) of the messages that are regenerated at some time, n their places in the log. Walks each
    conversation with the places of those of them that stand.
    """
    kind = events.schema["conv_id"].dataType.simpleString()

    def row(standing, values):
        _, n, event, message = values
        place = standing.setdefault(message, n)  # in order of place, as later ones are put behind
        if event != "regenerate" or place == n:
            return []
        while (last := next(reversed(standing))) != message:
            del standing[last]
        return [(values[0], place, n)]

    ordered = events.select("conv_id", "n", "event", "message_id").repartition("conv_id").sortWithinPartitions("conv_id", "n")
    return stream(ordered, dict, row, lambda key, standing: [], f"conv_id {kind}, after bigint, until bigint")


def fold(events: DataFrame) -> DataFrame:
    """Final message fragments: conv_id, position, part, whole, role, text; a message is a fragment that is whole, or those of a position, joined by part.

    events: conv_id, seq (long, the order), event (EVENTS), message_id (string or null), role, text. An event without a
    message_id is a whole message of its own. With one: the first event fixes its position and role; message and edit set its text anew, delta
    appends, regenerate empties it and takes back all messages that stand after it by then, delete empties it and hides it, deltas that follow
    included, until an event sets it again. A message that was taken back and gets an event later begins anew, at that event's position.
    Null texts count as empty, null events as message; unknown events are an error. Equal seqs are
    ordered by message_id, role, text, then event. Null conv_ids make one conversation, null seqs come first.
    """
    e = events.select("conv_id", F.col("seq").cast("long").alias("seq"), F.coalesce("event", F.lit("message")).alias("event"), F.col("message_id").cast("string").alias("message_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    e = e.withColumn("event", F.when(F.col("event").isin(*EVENTS), F.col("event")).otherwise(F.raise_error(F.concat(F.lit("unknown event "), F.col("event")))))
    order = Window.partitionBy("conv_id").orderBy("seq", F.coalesce("message_id", F.lit("")), "role", "text", "event")
    e = e.withColumn("n", F.row_number().over(order).cast("long"))
    message = Window.partitionBy("conv_id", "message_id")
    again = e.where("message_id is not null").select("conv_id", "n", "event", "message_id").withColumn("cuts", F.max(F.col("event") == "regenerate").over(message)).where("cuts")
    cuts = taken_back(again).select("conv_id", F.col("after").alias("n"), "until")
    # what lies between a regenerated message and its regeneration stands no more
    missing = {c: F.lit(None).cast("string") for c in ("event", "message_id", "role", "text")}
    marked = e.withColumn("until", F.lit(None).cast("long")).drop("seq").unionByName(cuts.withColumns(missing))
    earlier = Window.partitionBy("conv_id").orderBy("n", F.col("until").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("reach", F.max("until").over(earlier)).where("event is not null")
    stands = F.col("reach").isNull() | (F.col("reach") <= F.col("n"))
    begun = marked.withColumn("begin", F.min(F.when(stands, F.struct("n", "role"))).over(message))
    live = begun.withColumn("last", F.max(F.when((F.col("event") != "delta") & (F.col("n") >= F.col("begin.n")), F.struct("n", "event"))).over(message))
    alone = F.col("message_id").isNull()
    kept = (alone & stands) | (~alone & (F.col("n") >= F.col("begin.n")) & (F.col("last").isNull() | ((F.col("n") >= F.col("last.n")) & (F.col("last.event") != "delete"))))
    return live.where(kept).select("conv_id", F.when(alone, F.col("n")).otherwise(F.col("begin.n")).alias("position"), F.col("n").alias("part"), alone.alias("whole"), F.when(alone, F.col("role")).otherwise(F.col("begin.role")).alias("role"), F.when(F.col("event") == "regenerate", F.lit("")).otherwise(F.col("text")).alias("text"))


def stream(df: DataFrame, start, row, end, schema: str) -> DataFrame:
    """Walks rows that lie sorted by their first column: start() makes a conversation's state, row(state, values) and end(key, state) yield rows of schema."""
    from pyspark.sql.types import _parse_datatype_string

    target = pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}[f.dataType.simpleString()]) for f in _parse_datatype_string(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out, size, begun = None, None, [], 0, False

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for values in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True):
                    if not begun or values[0] != key:
                        if begun:
                            out += end(key, state)
                        key, state, begun = values[0], start(), True
                    new = row(state, values)
                    out += new
                    size += sum(len(v) for r in new for v in r if isinstance(v, str))
                    if len(out) >= 512 or size > 1 << 22:
                        yield flush()
                        out, size = [], 0
        if begun:
            out += end(key, state)
        if out:
            yield flush()

    return bounded(df).mapInArrow(run, schema)


def render(messages: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """The formatted text in pieces: conv_id, piece_no, piece, loss_start, loss_end (code points within the piece), in order within partitions.

    messages: as fold returns them. Joining a conversation's pieces by piece_no gives its formatted text.
    """
    kind = messages.schema["conv_id"].dataType.simpleString()
    # a window asks for a conversation's rows in one partition, which fold has left so: nothing is shuffled for it
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("position", "part"))
    lined = messages.withColumn("number", number).where("number > 0").sortWithinPartitions("conv_id", "position", "part").select("conv_id", "position", "whole", "role", "text")

    def start():
        return {"n": 0, "position": None, "role": "", "parts": []}

    def close(key, s):
        if s["position"] is None:
            return []
        piece, a, b = template.render(s["role"], "".join(s["parts"]))
        s["n"] += 1
        return [(key, s["n"] - 1, piece, a, b)]

    def row(s, values):
        key, position, whole, role, text = values
        out = []
        if whole or position != s["position"]:
            out = close(key, s)
            s["position"], s["role"], s["parts"] = position, role, []
        s["parts"].append(text)
        return out

    return stream(lined, start, row, close, f"conv_id {kind}, piece_no bigint, piece string, loss_start int, loss_end int")


def read_back(pieces: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """A row a conversation, parsed from its pieces: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    pieces: as render returns them, in the order it leaves. turns_sha256 is over role, newline, text, newline of each turn;
    loss_* are over all text under the loss spans, unescaped.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def start():
        return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}

    def row(s, values):
        _, piece, a, b = values
        role, text = template.parse(piece)
        s["n"] += 1
        s["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if b > a:
            masked = template.unescape(piece[a:b])
            s["loss"].update(masked.encode("utf-8", "surrogatepass"))
            s["loss_chars"] += len(masked)
        s["chars"] += len(piece)
        return []

    def end(key, s):
        return [(key, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"])]

    return stream(pieces.select("conv_id", "piece", "loss_start", "loss_end"), start, row, end, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
