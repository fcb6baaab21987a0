"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a text.  Its parts are never
looked into: successive prefixes of a conversation are rendered and consecutive
outputs compared.  If one output begins with the one before, what was added is the
turn's span; if not, the template rewrites history, and the turns whose
spans moved are reported.  Where the text of a turn stands within its span is found
by rendering the prefix once more with a probe in its place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>(.*?) \[INST\] (.*?) \[/INST\]</s>\n", re.S)
PROBE = "probe"


def escape(text: str) -> str:
    """No control string is left; ``unescape`` gives text back."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def marked_template(turns: list[Turn]) -> str:
    """Every turn as ``<s>role [INST] text [/INST]</s>`` and a line end, role and text escaped."""
    return "".join(_short(role, text) if len(text) < 2048 else _one(role, text) for role, text in turns)


def _one(role: str, text: str) -> str:
    return f"<s>{escape(role)} [INST] {escape(text)} [/INST]</s>\n"


_short = lru_cache(maxsize=8192)(_one)  # a turn is rendered with every prefix that holds it


def parse_marked(span: str) -> Turn:
    """Role and text of one rendered turn."""
    m = _TURN.fullmatch(span)
    if m is None:
        raise ValueError("not one turn of this template")
    return unescape(m[1]), unescape(m[2])


def spans(render: Callable[[list[Turn]], str], turns: list[Turn]) -> tuple[str, list[tuple[int, int]], list[int]]:
    """(output, span of each turn, turns whose prefix rewrote what stood before).

    A rewriting turn's span begins where its output first differs from the one before.
    """
    out, found, rewrites = "", [], []
    for k in range(1, len(turns) + 1):
        now = render(turns[:k])
        at = len(out)
        if not now.startswith(out):
            rewrites.append(k - 1)
            at = next((i for i, (a, b) in enumerate(zip(out, now, strict=False)) if a != b), min(len(out), len(now)))
            found = [(min(a, at), min(b, at)) for a, b in found]
        found.append((at, len(now)))
        out = now
    return out, found, rewrites


def text_span(render: Callable[[list[Turn]], str], turns: list[Turn], k: int, length: int) -> tuple[int, int] | None:
    """Where turn k's text stands in the rendered prefix of k+1 turns, which has length characters."""
    probe = PROBE
    while any(probe in x for turn in turns[: k + 1] for x in turn):
        probe += ""
    out = render([*turns[:k], (turns[k][0], probe)])
    at = out.find(probe)
    return None if at < 0 else (at, length - (len(out) - len(probe) - at))


def format_conversation(turns: list[Turn], render=marked_template, trained: tuple[str, ...] = ("assistant",)) -> dict:
    """formatted text, span of each turn, spans of texts under the loss mask, turns that rewrite history.

    Under the mask are the texts of the roles in trained, each once and in order; if
    the template rewrites history, only those of turns that are still as first rendered.
    """
    out, found, rewrites = spans(render, turns)
    mask = []
    for k, ((role, _), (_, end)) in enumerate(zip(turns, found, strict=True)):
        if role in trained and not any(r > k for r in rewrites):
            at = text_span(render, turns, k, end)
            if at is not None:
                mask.append(at)
    return {"formatted": out, "spans": found, "mask": mask, "rewrites": rewrites}


_FORMATTED = "conv_id long, formatted string, span_starts array<int>, span_ends array<int>, mask_starts array<int>, mask_ends array<int>, rewrites array<int>"


def format_conversations(conversations: DataFrame, render=marked_template, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: its text, spans of turns and of texts under the loss mask.

    Rows go by turn (a null turn first, ties by role, then text; repeated rows stay); a
    null role or text is empty; rows with a null conv_id make a conversation of id
    null; rows of one id are one conversation, wherever they come from; other columns are ignored; an
    empty table gives no rows.  A conversation is formatted as a whole by one task, with a rendering for
    each prefix, so its cost grows with the square of its turns.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(it):
        for batch in it:
            out = []
            for conv, ts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = format_conversation([(t["role"], t["text"]) for t in ts], render, trained)
                out.append((conv, r["formatted"], [a for a, _ in r["spans"]], [b for _, b in r["spans"]], [a for a, _ in r["mask"]], [b for _, b in r["mask"]], r["rewrites"]))
            types = [pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 5]
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "formatted", "span_starts", "span_ends", "mask_starts", "mask_ends", "rewrites"])

    return turns.mapInArrow(run, _FORMATTED)


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Digests read back from the output of format_conversations with the marked template."""

    def run(it):
        for batch in it:
            out = []
            for conv, text, a, b, ma, mb in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                turns = hashlib.sha256()
                for x, y in zip(a, b, strict=True):
                    role, t = parse_marked(text[x:y])
                    turns.update(f"{role}\n{t}\n".encode("utf-8", "surrogatepass"))
                loss = "".join(unescape(text[x:y]) for x, y in zip(ma, mb, strict=True))
                out.append((conv, len(a), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
