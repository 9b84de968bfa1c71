"""Chat formatting from event logs: fold events into final messages, then render them by a template.

A log is dealt out by conversation and sorted by sequence. Folding runs over the sorted rows of a task as they come and
holds one open message at a time, so a conversation may be longer than memory. Each final message becomes one rendered
segment; a conversation's text is its segments in order. Control strings inside texts are escaped, so that the text can
be read back.

Events: ``message`` (a whole message), ``delta`` (text streamed onto the open message, opening it if there is none of
that turn), ``edit`` (replaces the turn's text), ``regenerate`` (drops the turn's text; what follows builds it anew).
Events of a turn that is no longer the last are folded too: the log is sorted by (conversation, turn, sequence).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template. What stands before and after a message of each role; others get the ROLE form.
BEFORE = {"system": "<s>[SYS] ", "user": "<s>[INST] ", "assistant": "<s>[ANS] "}
AFTER = {"system": " [/SYS]", "user": " [/INST]", "assistant": " [/ANS]</s>"}
OTHER_BEFORE, OTHER_BETWEEN, OTHER_AFTER = "<s>[ROLE] ", " [TEXT] ", " [/ROLE]"
#: The role whose texts are learnt.
LEARNT = "assistant"
_CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?(?:SYS|INST|ANS|ROLE|TEXT)\])")
_ESCAPED = re.compile(r"\\(.)", re.S)
_NAME = {v: k for k, v in BEFORE.items()}


def escape(text: str) -> str:
    """Put a backslash before every backslash and every start of a control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str | None, text: str) -> tuple[str, int, int]:
    """The segment of a message, and from where to where its text is under the loss mask (0, 0: none)."""
    body = escape(text)
    if role in BEFORE:
        head, tail = BEFORE[role], AFTER[role]
    else:
        head, tail = OTHER_BEFORE + escape(role or "") + OTHER_BETWEEN, OTHER_AFTER
    return head + body + tail, *((len(head), len(head) + len(body)) if role == LEARNT else (0, 0))


def read_segment(segment: str) -> tuple[str, str]:
    """The role and text of a segment."""
    for head, role in _NAME.items():
        if segment.startswith(head) and segment.endswith(AFTER[role]):
            return role, unescape(segment[len(head) : len(segment) - len(AFTER[role])])
    rest = segment[len(OTHER_BEFORE) : len(segment) - len(OTHER_AFTER)]
    at = next(m.start() for m in re.finditer(re.escape(OTHER_BETWEEN), rest) if _open(rest, m.start() + 1))
    return unescape(rest[:at]), unescape(rest[at + len(OTHER_BETWEEN) :])


def _open(text: str, at: int) -> bool:
    """Whether the character at this place is not escaped."""
    n = 0
    while at - n > 0 and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 0


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of rows sorted by conversation, turn and sequence."""
    now: tuple | None = None
    role: str | None = None
    parts: list[str] = []
    number = 0

    def close() -> tuple:
        return (now[0], number, *render(role, "".join(parts)))

    for batch in batches:
        out = []
        for conv, turn, whole, kind, r, text in zip(batch["conv_id"], batch["turn"], batch["row"], batch["kind"], batch["role"], batch["text"], strict=True):
            key = (conv, turn, whole)
            if key != now:
                if now is not None:
                    out.append(close())
                number = number + 1 if now is not None and now[0] == conv else 0
                now, role, parts = key, r, []
            text = text or ""
            if kind == "delta":
                parts.append(text)
            elif kind == "regenerate":
                parts = []
            else:
                parts = [text]
            role = r if r is not None else role
        yield pd.DataFrame(out, columns=["conv_id", "segment", "rendered", "loss_from", "loss_to"])
    if now is not None:
        yield pd.DataFrame([close()], columns=["conv_id", "segment", "rendered", "loss_from", "loss_to"])


def event_log(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) as the log of a service that streams, edits and regenerates them.

    By a hash, a message comes whole, as four deltas, as a draft that an edit replaces, or as a part that a regeneration
    drops before the whole comes in two deltas. Rows of one turn are messages of their own, in the order of role and
    text. Columns: conv_id, turn, message, seq, kind, role, text; folding them gives the messages again.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    quarter, half = (F.ceil(F.length(text) / n).cast("int") for n in (4, 2))
    event = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))
    deltas = lambda n, size: [event("delta", F.substring(text, F.lit(1) + size * i, size)) for i in range(n)]
    forms = [
        F.array(event("message", text)),
        F.array(*deltas(4, quarter)),
        F.array(event("message", F.concat(F.lit("draft of "), F.substring(text, 1, 20))), event("edit", text)),
        F.array(event("delta", F.substring(text, F.lit(1), half)), event("regenerate", F.lit("")), *deltas(2, half)),
    ]
    way = F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(len(forms)))
    log = forms[0]
    for i, form in enumerate(forms[1:], 1):
        log = F.when(way == i, form).otherwise(log)
    within = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = messages.withColumn("message", F.row_number().over(within))
    return rows.select("conv_id", "turn", "message", "role", F.posexplode(log).alias("seq", "event")).select("conv_id", "turn", "message", "seq", "event.kind", "role", "event.text")


def format_chats(events: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", message_col: str | None = None, seq_col: str | None = None, kind_col: str | None = None, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Render conversations: rows (conv_id, segment, rendered, loss_from, loss_to), a segment for each final message.

    ``loss_from`` and ``loss_to`` bound, in characters of the segment, the text that is learnt (both 0: none).
    Without ``kind_col`` every row is a message of its own, also rows of one turn; these are put in the order of
    sequence, role and text. With it, a null kind is a message, and the events of one turn make one message, or one for
    each ``message_col`` of the turn, in its order. Null
    texts are empty; a null role keeps the role that the turn has, or is the empty role. Null conversation ids form
    one conversation, null turns come first. An empty table gives none. Other columns are not read.
    """
    seq = F.col(seq_col) if seq_col else F.lit(0)
    kind = F.coalesce(F.col(kind_col), F.lit("message")) if kind_col else F.lit("message")
    rows = events.select(*_event_columns(conv_col, turn_col, seq, kind, role_col, text_col))
    if kind_col:
        rows = events.select(F.col(message_col).cast("long").alias("row") if message_col else F.lit(0).cast("long").alias("row"), *_event_columns(conv_col, turn_col, seq, kind, role_col, text_col))
        order = ("conv_id", "turn", "row", "seq", "role", "text")
    else:
        rows, order = rows.withColumn("row", F.monotonically_increasing_id()), ("conv_id", "turn", "seq", "role", "text", "row")
    rows = rows.repartition("conv_id").sortWithinPartitions(*order)
    typed = rows.select(F.struct("conv_id").alias("conv_id"), F.struct("turn").alias("turn"), "row", "kind", "role", "text")
    kinds = "conv_id struct<conv_id:long>, segment long, rendered string, loss_from long, loss_to long"
    return typed.mapInPandas(_unwrapped, kinds).withColumn("conv_id", F.col("conv_id.conv_id"))


def _event_columns(conv: str, turn: str, seq: Column, kind: Column, role: str, text: str) -> list[Column]:
    return [F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), seq.cast("long").alias("seq"), kind.alias("kind"), F.col(role).alias("role"), F.col(text).alias("text")]


def _unwrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Structs keep null ids apart from numbers; a task turns them into plain keys and back."""

    def plain() -> Iterator[pd.DataFrame]:
        for b in batches:
            # As objects: among numbers, pandas would make null ids floats, which differ from each other.
            yield b.assign(**{c: pd.Series([_only(x) for x in b[c]], b.index, dtype=object) for c in ("conv_id", "turn")})

    for out in _folded(plain()):
        yield out.assign(conv_id=[{"conv_id": x} for x in out["conv_id"]])


def _only(x) -> int | None:
    value = next(iter(x.values())) if isinstance(x, dict) else x[0]
    return None if value is None or value != value else int(value)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of conversations from their sorted segments, read back."""
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now: tuple | None = None
    state: list = []

    def close() -> tuple:
        return ({"conv_id": now[0]}, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    for batch in batches:
        out = []
        for conv, rendered, a, b in zip(batch["conv_id"], batch["rendered"], batch["loss_from"], batch["loss_to"], strict=True):
            key = (_only(conv),)
            if key != now:
                if now is not None:
                    out.append(close())
                now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_segment(rendered)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            learnt = unescape(rendered[int(a) : int(b)])
            state[2] += len(learnt)
            state[3].update(learnt.encode("utf-8", "surrogatepass"))
            state[4] += len(rendered)
        yield pd.DataFrame(out, columns=columns)
    if now is not None:
        yield pd.DataFrame([close()], columns=columns)


def read_chats(segments: DataFrame) -> DataFrame:
    """What rendered conversations hold: a row of counts and digests for each, from segments as ``format_chats`` gives them."""
    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment").select(F.struct("conv_id").alias("conv_id"), "rendered", "loss_from", "loss_to")
    kinds = "conv_id struct<conv_id:long>, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInPandas(_read, kinds).withColumn("conv_id", F.col("conv_id.conv_id"))
