"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, remembering the character span of every
turn's text, and encoded once with offsets. A token is under the loss mask if
its span meets the span of an assistant's text; both lists are sorted, so the
meeting is found by binary search.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices
from tessera.llm.sentencepiece_codec import read_model

#: The template's control strings (fixed values). Each is one token of its own,
#: so that no token reaches from a text into the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
LOSS_ROLES = ("assistant",)


def escape(text: str) -> str:
    """A text without ``<|``: one backslash more between the two, whatever stands there."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "|" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int], list[str]]:
    """The formatted conversation and, for each turn, its text's span and its role."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        starts.append(at + len(head))
        ends.append(at + len(head) + len(body))
        parts += (head, body, END)
        at = ends[-1] + len(END)
    return "".join(parts), starts, ends, [r for r, _ in turns]


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, as they were before rendering."""
    out = []
    for turn in formatted.split(START)[1:]:
        role, _, rest = turn.partition(SEP)
        out.append((unescape(role), unescape(rest[: -len(END)])))
    return out


def masked(token_starts, token_ends, span_starts, span_ends) -> np.ndarray:
    """Which tokens meet a span. Both are sorted; spans do not overlap; empty spans meet none."""
    if not len(span_starts):
        return np.zeros(len(token_starts), bool)
    span_starts, span_ends = np.asarray(span_starts), np.asarray(span_ends)
    real = span_ends > span_starts
    span_starts, span_ends = span_starts[real], span_ends[real]
    k = np.searchsorted(span_ends, token_starts, side="right")  # the first span that ends after the token starts
    inside = k < len(span_starts)
    return inside & (span_starts[np.minimum(k, len(span_starts) - 1)] < token_ends) if len(span_starts) else inside


def loss_spans(starts, ends, span_starts, span_ends) -> list[tuple[int, int]]:
    """The runs of text under the mask, in order: of each span, what its tokens cover, cut to the span and merged."""
    out = []
    first, last = np.searchsorted(ends, span_starts, side="right"), np.searchsorted(starts, span_ends, side="left")
    for a, b, i, j in zip(span_starts.tolist(), span_ends.tolist(), first.tolist(), last.tolist()):
        if i < j and a < b:
            x, y = np.maximum(starts[i:j], a), np.maximum.accumulate(np.minimum(ends[i:j], b))
            cut = np.flatnonzero(x[1:] > y[:-1]) + 1
            out += zip(x[np.append(0, cut)].tolist(), y[np.append(cut, len(y)) - 1].tolist())
    return out


def _lists(arrays, kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays), kind))


def _spans(lists) -> pa.ListArray:
    flat = np.array([x for spans in lists for x in spans], np.int32).reshape(-1, 2)
    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def make_tokenizer(data: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_str(data.decode())
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, SEP, END)])
    return t


def conversations_in_order(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` of ``rows(conv_id, turn, role, text)``: turns by number, null first, ties by role and text."""
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


SCHEMA = (
    "conv_id bigint, formatted string, input_ids array<int>, loss_mask array<boolean>,"
    " turn_spans array<struct<start: int, end: int>>, loss_spans array<struct<start: int, end: int>>"
)


def format_conversations(rows: DataFrame, tokenizer: str = TOKENIZER, loss_roles=LOSS_ROLES) -> DataFrame:
    """Every conversation rendered, encoded and masked; a row for each conv_id.

    ``formatted`` is the rendered text, ``input_ids`` its tokens, ``loss_mask``
    the tokens under the loss, ``turn_spans`` each turn's text and
    ``loss_spans`` the text under the loss, in code points of ``formatted``.
    Null texts and roles are empty; rows with a null conv_id are one
    conversation; repeated rows are turns of their own; control strings in
    texts and roles are escaped; other columns are not read; no rows give none.
    A conversation is one row and so has to fit into a task, its neighbours
    need not.
    """
    data = read_model(rows.sparkSession, tokenizer)

    def run(batches):
        t = make_tokenizer(data)
        for batch in batches:
            for part in slices(batch, 64):
                texts, ids, masks, turns, loss = [], [], [], [], []
                rendered = [render([(x["role"], x["text"]) for x in turns]) for turns in part.column(1).to_pylist()]
                for (text, starts, ends, roles), e in zip(rendered, t.encode_batch([r[0] for r in rendered], add_special_tokens=False)):
                    offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                    own = [k for k, r in enumerate(roles) if r in loss_roles]
                    a, b = np.array([starts[k] for k in own], np.int64), np.array([ends[k] for k in own], np.int64)
                    texts.append(text)
                    ids.append(np.array(e.ids, np.int32))
                    masks.append(masked(offsets[:, 0], offsets[:, 1], a, b))
                    turns.append(list(zip(starts, ends)))
                    loss.append(loss_spans(offsets[:, 0], offsets[:, 1], a, b))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), _lists(ids, pa.int32()), _lists(masks, pa.bool_()), _spans(turns), _spans(loss)],
                    names=["conv_id", "formatted", "input_ids", "loss_mask", "turn_spans", "loss_spans"],
                )

    return conversations_in_order(rows).mapInArrow(run, SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """What reading formatted conversations back gives: turns and the text under the loss."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = [[] for _ in range(5)]
                for text, spans in zip(part.column(1).to_pylist(), part.column(4).to_pylist()):
                    turns = parse(text)
                    loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                    row = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
                    for column, value in zip(out, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, out), part.column(2), part.column(3)],
                    names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"],
                )

    counts = F.size("input_ids").cast("bigint").alias("n_tokens"), F.size(F.array_remove("loss_mask", F.lit(False))).cast("bigint").alias("loss_tokens")
    return formatted.select("conv_id", "formatted", *counts, "loss_spans").mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint"
    )
