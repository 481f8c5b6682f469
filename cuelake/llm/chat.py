r"""Chat formatting that is proved by parsing it back.

A turn is written as `### role: body</turn>` and a newline. A deterministic parser reads a header, a body up
to the first unescaped end mark, and takes any backslash as an escape; an unescaped `###` in a body is an
error. Each turn is first written as it is and parsed; where the parse isn't the source, its escape
characters and the characters that control strings start with (`\`, `#`, `<`) are escaped, and it's parsed
again. So only conflicting content is changed, and every written turn is known to read back.

The loss mask covers assistants' bodies. Turns are written where their rows are. What needs a conversation in
order (its text, its digests) is streamed: rows are dealt out by conversation, sorted there, and read one
after another, so a conversation of any length takes constant memory. One conversation's digest is one
sequence, hence one task.

Defined cases: null text or role counts as empty; rows with a null conv_id are one conversation; a null turn
comes first; turns of the same number are ordered by role, then text, and repeated rows are turns of their
own; an empty table gives an empty result. A turn's text is written and parsed whole, in time linear in its length,
however long it is; a task holds one turn at a time beside its Arrow batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</turn>"
LOSS_ROLE = "assistant"
_TURN = re.compile(r"### ((?:[^\\:#<]+|\\.|#(?!##)|<(?!/turn>))*+): ((?:[^\\#<]+|\\.|#(?!##)|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, also: str = "") -> str:
    return re.sub(rf"([\\#<{also}])", r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start of the body, its end) of each turn; ValueError where the grammar doesn't hold."""
    turns, at = [], 0
    while at < len(rendered):
        if (m := _TURN.match(rendered, at)) is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return turns


def render(role: str, text: str) -> str:
    """One turn, escaped as far as its round trip needs."""
    head = escape(role, ":") if re.search(r"[\\#<:]", role) else role
    for body in (text, escape(text)):
        rendered = f"### {head}: {body}{END}\n"
        try:
            if [(r, t) for r, t, *_ in parse(rendered)] == [(role, text)]:
                return rendered
        except ValueError:
            pass
    raise AssertionError("an escaped turn must read back")


def _render_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, texts = batch.column(2).to_pylist(), batch.column(3)
        rendered, starts, ends = [], [], []
        for role, text in zip(roles, texts, strict=True):
            out = render(role, text.as_py())
            ((_, _, a, b),) = parse(out)
            rendered.append(out)
            starts.append(a if role == LOSS_ROLE else 0)
            ends.append(b if role == LOSS_ROLE else 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(rendered, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
            ["conv_id", "turn", "rendered", "loss_start", "loss_end"],
        )


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, rendered, loss_start, loss_end) of each row; the mask's range is within `rendered`, empty where no loss is taken.
    A conversation's text is its turns' `rendered`, in order, with nothing between."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    )
    return rows.mapInArrow(_render_batches, "conv_id long, turn long, rendered string, loss_start long, loss_end long")


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, rendered: str, start: int, end: int) -> None:
        for role, text, *_ in parse(rendered):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        masked = unescape(rendered[start:end])
        self.loss.update(masked.encode())
        self.loss_chars += len(masked)
        self.chars += len(rendered)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TYPES = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _TYPES, strict=True)], schema=_TYPES)

    now: _Digest | None = None
    for batch in batches:
        done = []
        ids, rendered, starts, ends = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for conv_id, text, a, b in zip(ids, rendered, starts, ends, strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.row())
                now = _Digest(conv_id)
            now.add(text.as_py(), a, b)
        if done:
            yield out(done)
    if now is not None:
        yield out([now.row()])


def digests(formatted: DataFrame) -> DataFrame:
    """What reading `format_turns` back gives for each conversation."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    return ordered.select("conv_id", "rendered", "loss_start", "loss_end").mapInArrow(_digest_batches, _DIGESTS)
