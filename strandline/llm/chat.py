"""Chat formatting that is proved by reparsing.

Grammar of a formatted conversation (a sequence of turns):

    turn      := user | assistant | other
    user      := "<s>[INST] " body " [/INST]"
    assistant := "<s>[OUT] " body " </s>"
    other     := "<s>[ROLE] " body "[AS] " body " [/ROLE]"     role, then text
    body      := ( any character | "\\" any character )*        up to the first closing mark outside an escape

A turn without control strings and backslashes is written as it is, any other with these escaped: a backslash goes before every
backslash and behind the first character of every control string, so that no control string is left in a body.  The parser reads the
result back; if the recovered turn is not the source, every character is escaped and the turn is
parsed again, until both are identical.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tools import id_of, parts

_OPEN = {"user": "<s>[INST] ", "assistant": "<s>[OUT] "}
_CLOSE = {"user": " [/INST]", "assistant": " </s>"}
_OTHER, _AS, _END = "<s>[ROLE] ", "[AS] ", " [/ROLE]"
_CONTROL = re.compile(r"\\|</?s>|\[/?(?:INST|OUT|ROLE|AS)\]")
_BODY = r"((?:[^\\]|\\.)*?)"
_TURN = re.compile(rf"<s>\[(?:INST\] {_BODY} \[/INST\]|OUT\] {_BODY} </s>|ROLE\] {_BODY}\[AS\] {_BODY} \[/ROLE\])", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, level: int) -> str:
    """Level 0: as it is.  1: control strings and backslashes.  2: every character, which is always read back."""
    if level == 0:
        return text
    return _CONTROL.sub(lambda m: m[0][: len(m[0]) > 1] + "\\" + m[0][len(m[0]) > 1 :], text) if level == 1 else re.sub(r"(.)", r"\\\1", text, flags=re.DOTALL)


def unescape(body: str) -> str:
    return _ESCAPED.sub(r"\1", body) if "\\" in body else body


def render(role: str, text: str, level: int) -> str:
    if role in _OPEN:
        return _OPEN[role] + escape(text, level) + _CLOSE[role]
    return _OTHER + escape(role, level) + _AS + escape(text, level) + _END


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the body) of each turn; ValueError if the grammar does not hold."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        user, assistant, role, other = m.groups()
        kind = 1 if user is not None else 2 if assistant is not None else 4
        name = "user" if kind == 1 else "assistant" if kind == 2 else unescape(role)
        if kind == 4 and name in _OPEN:
            raise ValueError(f"no turn at {at}")
        out.append((name, unescape(m[kind]), m.start(kind), m.end(kind)))
        at = m.end()
    return out


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The formatted turn, and the escape level at which it reads back identical."""
    for level in range(1 if _CONTROL.search(text) or (role not in _OPEN and _CONTROL.search(role)) else 0, 3):
        piece = render(role, text, level)
        try:
            back = parse(piece)
        except ValueError:
            continue
        if len(back) == 1 and back[0][:2] == (role, text):
            return piece, level
    raise ValueError("a turn cannot be formatted")


_PIECES = "conv_id long, turn long, role string, text string, formatted string, escape_level int, loss_start int, loss_end int"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        role, text = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        done = [format_turn(r, t) for r, t in zip(role, text, strict=True)]
        spans = [parse(p)[0][2:] if r == "assistant" else (None, None) for r, (p, _) in zip(role, done, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), batch.column("role"), batch.column("text"), pa.array([p for p, _ in done], pa.string()), pa.array([x for _, x in done], pa.int32()), pa.array([a for a, _ in spans], pa.int32()), pa.array([b for _, b in spans], pa.int32())],
            ["conv_id", "turn", "role", "text", "formatted", "escape_level", "loss_start", "loss_end"],
        )


def format_turns(conversations: DataFrame) -> DataFrame:
    """Every turn with its formatted text and the span of it under the loss mask.

    A conversation's formatted text is that of its turns in order.  Null text
    or role is empty; a null turn comes first; rows with equal turns stand in order of
    role, then text.  The loss mask covers the body of assistant turns.
    """
    c = conversations
    rows = c.select(id_of(c, "conv_id").alias("conv_id"), id_of(c, "turn").alias("turn"), *(F.coalesce(c[x].cast("string"), F.lit("")).alias(x) for x in ("role", "text")))
    return rows.mapInArrow(_pieces, _PIECES)


class _Digest:
    """What is read back from the formatted turns of a conversation, turn after turn."""

    def __init__(self, conv_id):
        self.conv_id, self.n, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text, _, _ in parse(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss.update(text.encode())
                self.loss_chars += len(text)

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in batches:
        out = []
        for conv_id, formatted in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.row())
                now = _Digest(conv_id)
            now.add(formatted)
        yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row()], schema=_DIGEST)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted text reads back as.

    Turns stream through in order, so a conversation of any length takes the memory of one batch.
    Rows without conv_id are one conversation; an empty table gives no rows.
    """
    rows = formatted.select("conv_id", "turn", "role", "text", "formatted")
    dealt = rows.repartition(parts(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "formatted").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
