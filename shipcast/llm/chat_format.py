"""Chat formatting by incremental black-box rendering.

A template is any callable ``messages -> str``.  It is called on successive
turn prefixes; the text that prefix i adds to prefix i-1 is the span of turn
i.  The text of a turn inside its span is found by rendering the prefix again
with that turn's text left empty and comparing the two outputs.  A template
whose longer prefix does not begin with the shorter one rewrites history: such
a conversation is flagged, since its earlier spans cannot be trusted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipcast.llm.common import ship_package

Message = tuple[str, str]

START, END = "<|im_start|>", "<|im_end|>"
#: a private-use character that marks the place of a turn's text
PROBE = "\ue000"


def escape(text: str) -> str:
    """Reversible: afterwards no control opener ``<|`` is left in the text."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return "\\".join(part.replace("<\\|", "<|") for part in text.split("\\\\"))


def _marked(messages: list[Message]) -> str:
    """A role ends at the first line break, so breaks in it are escaped too."""
    return "".join(
        START + escape(r).replace("\n", "\\n") + "\n" + escape(t) + END + "\n" for r, t in messages
    )


def _marked_role(span: str) -> str:
    role = span[len(START) : span.index("\n")]
    return "\\".join(p.replace("\\n", "\n").replace("<\\|", "<|") for p in role.split("\\\\"))


@dataclass(frozen=True)
class ChatTemplate:
    """``render`` is the black box.  ``decode`` undoes its escaping of a text;
    ``role_of`` reads a role from a turn's span (None: taken from the input)."""

    render: Callable[[list[Message]], str]
    decode: Callable[[str], str] = str
    role_of: Callable[[str], str] | None = None


MARKED = ChatTemplate(_marked, unescape, _marked_role)


def turn_spans(messages: list[Message], template: ChatTemplate) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """Rendered text, per turn (start, end, text start, text end), rewrites-history flag.

    Offsets are code points of the rendering in which the turn came last.
    """
    spans, before, rewrites = [], template.render([]), False
    for i, (role, text) in enumerate(messages):
        now = template.render(messages[: i + 1])
        start = len(before)
        if not now.startswith(before):
            rewrites = True
            start = _common(before, now)
        head = messages[:i]
        empty, probed = (template.render([*head, (role, t)]) for t in ("", PROBE))
        lo = start + _common(empty[start:], probed[start:])
        spans.append((start, len(now), lo, lo + max(0, len(now) - len(empty)) if text else lo))
        before = now
    return before, spans, rewrites


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def format_rows(rows: list[Message], template: ChatTemplate = MARKED) -> tuple:
    """Render one conversation and read everything back from the output."""
    out, spans, rewrites = turn_spans(rows, template)
    turns, loss = hashlib.sha256(), hashlib.sha256()
    loss_chars, mask = 0, []
    for (role, _), (start, stop, lo, hi) in zip(rows, spans):
        read_role = template.role_of(out[start:stop]) if template.role_of else role
        text = template.decode(out[lo:hi])
        turns.update(f"{read_role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if read_role == "assistant":
            loss_chars += len(text)
            loss.update(text.encode("utf-8", "surrogatepass"))
            mask.append((lo, hi))
    return out, mask, rewrites, turns.hexdigest(), loss_chars, loss.hexdigest()


FORMATTED = (
    "conv_id long, n_turns long, text string, loss_spans array<struct<start:long,stop:long>>, "
    "rewrites_history boolean, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def format_conversations(turns: DataFrame, template: ChatTemplate = MARKED) -> DataFrame:
    """One row per conversation: the rendered text, the loss mask as code-point
    spans, and digests read back from the output.

    Input: ``conv_id, turn, role, text`` (other columns are ignored).  Rows are
    ordered by turn (null first), then role, then text, so ties and repeated
    rows have one defined order and all stay.  Null role or text count as
    empty; a null conv_id is a conversation of its own; an empty table gives
    no rows.  A conversation is one unit of text, so its turns meet in one row.
    """
    ship_package(turns.sparkSession)
    packed = (
        turns.select(
            "conv_id",
            F.struct(
                F.col("turn").alias("turn"),
                F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"),
            ).alias("m"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("m")).alias("ms"))
        .select("conv_id", F.col("ms.role").alias("roles"), F.col("ms.text").alias("texts"))
    )

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for conv, roles, texts in zip(pdf["conv_id"], pdf["roles"], pdf["texts"]):
                rows = list(zip(roles, texts))
                text, mask, rewrites, turns_hex, n, loss_hex = format_rows(rows, template)
                out.append(
                    (
                        None if pd.isna(conv) else int(conv),
                        len(rows),
                        text,
                        [{"start": a, "stop": b} for a, b in mask],
                        rewrites,
                        turns_hex,
                        n,
                        loss_hex,
                        len(text),
                    )
                )
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in FORMATTED.split(", ")])
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            yield frame

    return packed.mapInPandas(render, FORMATTED)
