"""Chat formatting with offset-aligned loss masks.

A conversation is rendered once: every turn is ``[INST]role[/INST]text</s>``. Where a role or text holds a
control string, a backslash is put after its first character (and one more where backslashes stand there
already), so control strings occur where the template writes them and nowhere else, and taking one backslash
away restores the text. The rendered conversation is encoded once, with offsets, by a tokenizer in which the
control strings are single ids, so no id crosses the edge of a turn; the sorted spans of the assistant's texts
are met with the ids' spans by binary search, which gives the loss mask.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker, shuffle_partitions, slices

OPEN, SAYS, END = "[INST]", "[/INST]", "</s>"
_ESCAPE = re.compile("|".join(rf"(?<=\{c[0]})(?=\\*{re.escape(c[1:])})" for c in (OPEN, SAYS, END)))
_RESTORE = re.compile("|".join(rf"(?<=\{c[0]})\\(?=\\*{re.escape(c[1:])})" for c in (OPEN, SAYS, END)))
_TURN = re.compile(rf"{re.escape(OPEN)}(.*?){re.escape(SAYS)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\", text)


def restore(text: str) -> str:
    return _RESTORE.sub("", text)


def render(turns: list[tuple[str, str]], learns: str = "assistant") -> tuple[str, np.ndarray]:
    """The conversation, and the [start, end) spans of the texts of role ``learns``, sorted; empty texts have none."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{SAYS}", escape(text)
        if role == learns and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}")
        at += len(parts[-1])
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns = [(restore(m[1]), restore(m[2])) for m in _TURN.finditer(formatted)]
    if sum(m.end() - m.start() for m in _TURN.finditer(formatted)) != len(formatted):
        raise ValueError("not a rendered conversation")
    return turns


def mask(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 for ids whose characters lie in a span; ``spans`` are sorted and apart."""
    if not len(spans):
        return np.zeros(len(starts), np.uint8)
    k = np.searchsorted(spans[:, 0], starts, side="right") - 1
    return ((k >= 0) & (ends <= spans[np.maximum(k, 0), 1]) & (ends > starts)).astype(np.uint8)


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The runs of characters under the mask, each unescaped: ids that share a character (its bytes) or touch are of one run."""
    runs: list[list[int]] = []
    for a, b in zip(starts[loss > 0].tolist(), ends[loss > 0].tolist(), strict=True):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    return [restore(formatted[a:b]) for a, b in runs]


def chat_tokenizer(path: str):
    """The tokenizer with the control strings as ids of their own, and offsets that keep white space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.add_tokens([AddedToken(c, normalized=False, special=False) for c in (OPEN, SAYS, END)])
    t.encode_special_tokens = True
    return t


SCHEMA = "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss binary"


def format_chats(rows: DataFrame, tokenizer: str, learns: str = "assistant") -> DataFrame:
    """(conv_id, formatted, ids, starts, ends, loss): one row for each conv_id of ``rows`` (conv_id, turn, role, text).

    Turns are in the order of turn, ties by role and text, nulls first; repeated rows are turns each; a null
    role or text counts as empty; rows without a conv_id are one conversation. loss has a byte for each id, 1
    where it is learnt. Rows are dealt and sorted by conversation and read one after the other, so what a task
    holds is one conversation, not its share of the table; no column but the four is read; an empty table gives
    no rows.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = per_worker(chat_tokenizer, tokenizer)
        done: list[dict] = []
        size = 0

        def close(conv, turns) -> dict:
            formatted, spans = render(turns, learns)
            e = t.encode(formatted, add_special_tokens=False)
            at = np.array(e.offsets, np.int64).reshape(-1, 2)
            return {"conv_id": conv, "formatted": formatted, "ids": np.array(e.ids, np.int32), "starts": at[:, 0].astype(np.int32), "ends": at[:, 1].astype(np.int32), "loss": mask(spans, at[:, 0], at[:, 1]).tobytes()}

        def batch_of(found: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in _KINDS], [k for k, _ in _KINDS])

        held, turns, started = None, [], False
        for batch in slices(batches, limit=2 << 20):
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if started and conv != held:
                    done.append(close(held, turns))
                    turns = []
                    size += len(done[-1]["ids"])
                    if size > 1 << 18:
                        yield batch_of(done)
                        done, size = [], 0
                held, started = conv, True
                turns.append((role or "", text or ""))
        if started:
            done.append(close(held, turns))
        if done:
            yield batch_of(done)

    keys = ("conv_id", "turn", "role", "text")
    told = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = told.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*keys)
    return dealt.mapInArrow(mapped, SCHEMA)


_KINDS = [("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("loss", pa.binary())]


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_ids, n_loss_ids), from what format_chats returned and nothing else."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in slices(batches, "formatted", 2 << 20):
            out = []
            # the lists of ids and offsets stay Arrow's: a view for each row, no Python number for each id
            cut = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in ("ids", "starts", "ends")}
            for i, (conv, formatted, marks) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True)):
                ids, starts, ends = (values[at[i] : at[i + 1]] for at, values in cut.values())
                turns, loss = parse(formatted), np.frombuffer(marks, np.uint8)
                learnt = "".join(masked_text(formatted, starts, ends, loss))
                out.append((conv, len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(learnt), sha(learnt), len(formatted), len(ids), int(loss.sum())))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ids", "n_loss_ids"])

    return formatted.mapInArrow(mapped, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long, n_loss_ids long")
