"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of turns to text. It is rendered on the first turn,
the first two, and so on; where each output continues the one before, what it adds is the
span of the turn. A template that changes what it has written (drops or rewrites history)
shows at the first output that does not, and is reported instead of being given wrong
spans. Where a turn's own text lies in its span comes from two more renderings with probe
texts that share no character: what they have in common before and after is the frame.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]  # role, text
Template = Callable[[list[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """One more backslash between every ``<`` and ``|`` that only backslashes part, so no mark can arise."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def marked_turns(turns: list[Turn]) -> str:
    """The default template: every turn between marks, its role on the first line."""
    return "".join(f"{START}{_escape_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def parse_marked(output: str) -> list[Turn]:
    """Turns of an output of ``marked_turns``; raises if anything else stands in it."""
    turns, at = [], 0
    for m in _TURN.finditer(output):
        if m.start() != at:
            break
        turns.append((_unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(output):
        raise ValueError("not an output of this template")
    return turns


def _shared(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


@dataclass(frozen=True)
class Rendering:
    output: str
    spans: list[tuple[int, int] | None]  # of whole turns
    texts: list[tuple[int, int] | None]  # of the learnt roles' own text
    rewritten_at: int | None  # first turn whose output changed earlier text


def render(turns: list[Turn], template: Template = marked_turns, learn: str = "assistant") -> Rendering:
    """The output with the span of every turn, and of the text of turns of role ``learn``.

    From the turn at which history is rewritten on, spans cannot be told and are None, as
    are those of earlier turns that the last output no longer begins with.
    """
    before, ends, texts, broken = "", [], [], None
    for k in range(len(turns)):
        output = template(turns[: k + 1])
        if broken is None and not output.startswith(before):
            broken = k
        inner = None
        if broken is None and turns[k][0] == learn:
            a, b = (template([*turns[:k], (learn, probe)]) for probe in ("0", "1"))
            head, tail = _shared(a, b), _shared(a[::-1], b[::-1])
            if head + tail + 1 == len(a) == len(b) and output[:head] == a[:head] and (not tail or output[-tail:] == a[-tail:]):
                inner = (head, len(output) - tail)
        texts.append(inner)
        ends.append(len(output))
        before = output
    spans: list[tuple[int, int] | None] = [(s, e) for s, e in zip([0, *ends], ends, strict=False)]
    if broken is not None:
        good = _shared(template(turns[:broken]), before)
        spans = [s if k < broken and s and s[1] <= good else None for k, s in enumerate(spans)]
        texts = [t if s else None for s, t in zip(spans, texts, strict=True)]
    return Rendering(before, spans, texts, broken)


_SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()), ("formatted", pa.string()),
        ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64())), ("rewritten_at", pa.int64()),
    ]
)


def formatted(
    conversations: DataFrame, template: Template = marked_turns, learn: str = "assistant",
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """``conv_id, formatted, loss_starts, loss_ends, rewritten_at`` per conversation.

    Turns go by number (null first), then role and text, so repeated numbers have a fixed
    order and repeated rows stay. A null role or text counts as empty; a null id is a
    conversation of its own. The loss spans are code points of ``formatted``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = []
                for conv, turns in zip(batch.column(0)[at : at + 256].to_pylist(), batch.column(1)[at : at + 256].to_pylist(), strict=True):
                    done = render([(t["role"], t["text"]) for t in turns], template, learn)
                    found = [t for t in done.texts if t]
                    rows.append((conv, done.output, [s for s, _ in found], [e for _, e in found], done.rewritten_at))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    empty = F.lit("")
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("text"))
    turns = conversations.groupBy(F.col(conv_id).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("turns"))
    return turns.mapInArrow(run, "conv_id long, formatted string, loss_starts array<long>, loss_ends array<long>, rewritten_at long")


_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def read_back(output: str, loss: list[tuple[int, int]]) -> tuple[int, str, int, str, int]:
    """Turns and learnt text as they stand in an output of ``marked_turns``."""
    turns = parse_marked(output)
    learnt = "".join(unescape(output[s:e]) for s, e in loss)
    told = hashlib.sha256()
    for role, text in turns:
        told.update(f"{role}\n{text}\n".encode())
    return len(turns), told.hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(output)


def digest(conversations: DataFrame, **columns) -> DataFrame:
    """What can be read back from ``formatted``: number and hash of the turns, length and hash of the learnt text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (conv, *read_back(out, list(zip(starts, ends, strict=True))))
                for conv, out, starts, ends in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DIGEST, strict=True)], schema=_DIGEST)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted(conversations, **columns).mapInArrow(run, schema)
