"""Chat formatting with a grammar round trip.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``.  In roles and texts a backslash is put between ``<`` and
``|`` wherever these, with backslashes between them or none, could be read as a control string or as an escape; a line
break in a role is written ``<n>``, escaped in the same way.  A turn is first rendered as it stands; a deterministic parser
reads it back, and only if what it recovers differs from the source is the content escaped, until the two are identical.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
_ESCAPE = re.compile(r"<(?=\\*\|)")
_UNESCAPE = re.compile(r"<\\(?=\\*\|)")
#: In a role a line break is written as this and its own escape marks.
_BREAK = re.compile(r"<(?=\\*n>)")
_UNBREAK = re.compile(r"<\\(?=\\*n>)")


def escape(text: str) -> str:
    """One more backslash in every ``<``, backslashes, ``|``; :func:`unescape` takes it away."""
    return _ESCAPE.sub(r"<\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("<", text)


def escape_role(role: str) -> str:
    return escape(_BREAK.sub(r"<\\", role).replace("\n", "<n>"))


def unescape_role(role: str) -> str:
    return _UNBREAK.sub("<", unescape(role).replace("<n>", "\n"))


class Malformed(ValueError):
    """The formatted text is not what the grammar derives."""


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the written text) of every turn; a single pass without backtracking."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise Malformed(f"no turn begins at {at}")
        line = formatted.find("\n", at)
        end = formatted.find(END, line + 1) if line >= 0 else -1
        if end < 0 or START in formatted[at + len(START) : end] or END in formatted[at:line]:
            raise Malformed(f"the turn at {at} has no end of its own")
        if not formatted.startswith("\n", end + len(END)):
            raise Malformed(f"no line break at {end + len(END)}")
        turns.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end]), line + 1, end))
        at = end + len(END) + 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """The written turn, and the start and end of the text in it; parsing it gives ``role`` and ``text`` back."""
    written_role, written = role, text
    for _ in range(2):
        out = f"{START}{written_role}\n{written}{END}\n"
        try:
            found = parse(out)
        except Malformed:
            found = []
        if [(r, t) for r, t, _, _ in found] == [(role, text)]:
            return out, found[0][2], found[0][3]
        written_role, written = escape_role(role), escape(text)
    raise Malformed(f"no round trip for {role!r}")


def format_turns(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every row with its written form: ``conv_id``, ``turn``, ``formatted``, ``loss_start`` and ``loss_end``.

    A conversation's text is its rows' ``formatted`` in order of turn (then by what is written, if turns tie).  The loss mask
    covers code points ``loss_start`` to ``loss_end`` of a row: the text of an assistant's turn, else nothing.  Null roles and
    texts count as empty; repeated rows are turns of their own; rows with a null conversation form one; an empty table gives none.
    Turns are formatted where they lie, however long their conversation.
    """
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column(2).to_pylist()
            got = [render(r, t) for r, t in zip(roles, batch.column(3).to_pylist(), strict=True)]
            ends = [(s, e) if r == LOSS_ROLE else (0, 0) for r, (_, s, e) in zip(roles, got, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([s for s, _ in ends], pa.int64()), pa.array([e for _, e in ends], pa.int64())], ["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, formatted string, loss_start long, loss_end long")


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader recovers from each conversation of :func:`format_turns`, by parsing what was written.

    The rows of a conversation are sorted in one partition and hashed as they stream by, so memory holds a turn and not a
    conversation.  SHA-256 runs through a conversation in order, which is why its turns meet in one task.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    rows = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now = None

        def close():
            conv, n, turns, chars, loss, total = now
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(c)) if i else pa.array(list(c), kind_arrow) for i, c in enumerate(zip(*done, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return out

        kind_arrow = None
        for batch in batches:
            kind_arrow = batch.schema.field(0).type
            for conv, _, written, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(written):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                masked = unescape(written[start:end])
                now[3] += len(masked)
                now[4].update(masked.encode())
                now[5] += len(written)
            if len(done) >= 10_000:
                yield flush()
        if now is not None:
            close()
            yield flush()

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
