"""Operator 2: chat formatting by columnar byte assembly.

Every turn becomes three segments: a header, its text and a trailer. For a batch of turns the segments'
lengths, their running sums and the scatter indices of every byte are computed in numpy, and headers, texts
and trailers are copied into one preallocated buffer, which is the values buffer of the Arrow result.

Control strings inside texts are made harmless reversibly: one more backslash goes behind the first character
of anything that is a control string but for backslashes there, and reading takes one away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Strings around a turn. Headers and trailers end or begin with white space, so that no control string can
    form across a border; roles other than the two named ones go into `other` after escaping."""

    user: tuple[str, str] = ("<s>[INST] ", " [/INST]")
    assistant: tuple[str, str] = (" ", " </s>")
    other: tuple[str, str] = ("<<ROLE:{role}>>\n", "\n<</ROLE>>")
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<ROLE:", "<</ROLE>>")

    @property
    def loose(self) -> str:
        """A control string with any number of backslashes behind its first character."""
        return "|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in self.controls)

    def escape(self, text: str) -> str:
        return re.sub(self.loose, lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return re.sub(self.loose, lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)

    def segments(self, role: str) -> tuple[str, str]:
        if role in ("user", "assistant"):
            return getattr(self, role)
        safe = role.replace("\\", "\\\\").replace("\n", "\\n").replace(">", "\\g")
        return self.other[0].format(role=self.escape(safe)), self.other[1]

    def parse(self, formatted: str) -> list[tuple[str, str, int, int]]:
        """(role, text, start and length of the escaped text) of every turn of a formatted conversation."""
        out, at = [], 0
        head, tail = self.other[0].split("{role}")
        while at < len(formatted):
            if formatted.startswith(self.user[0], at):
                role, start, close = "user", at + len(self.user[0]), self.user[1]
            elif formatted.startswith(head, at):
                end = formatted.index(tail, at)
                role = re.sub(r"\\(.)", lambda m: {"n": "\n", "g": ">"}.get(m[1], m[1]), self.unescape(formatted[at + len(head) : end]))
                start, close = end + len(tail), self.other[1]
            else:
                role, start, close = "assistant", at + len(self.assistant[0]), self.assistant[1]
            # Texts hold no bare control string, so the first one closes the turn.
            end = formatted.index(close.strip(), start) - (len(close) - len(close.lstrip()))
            out.append((role, self.unescape(formatted[start:end]), start, end - start))
            at = end + len(close)
        return out


def assemble(parts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the row-wise concatenation of string columns of equal length without nulls."""
    n = len(parts[0])
    bounds, values = [], []
    for p in parts:
        p = p.cast(pa.large_binary())
        offsets = np.frombuffer(p.buffers()[1], dtype=np.int64)[p.offset : p.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(p.buffers()[2], dtype=np.uint8) if p.buffers()[2] is not None else np.empty(0, np.uint8)
        bounds.append(offsets)
        values.append(data)
    lengths = np.stack([np.diff(o) for o in bounds], axis=1)
    starts = np.cumsum(lengths.ravel()) - lengths.ravel()
    out = np.empty(int(lengths.sum()), dtype=np.uint8)
    starts = starts.reshape(lengths.shape)
    for k, (offsets, data) in enumerate(zip(bounds, values)):
        shift = np.repeat(starts[:, k] - offsets[:-1], lengths[:, k])
        out[np.arange(offsets[0], offsets[-1]) + shift] = data[offsets[0] : offsets[-1]]
    return np.concatenate([[0], np.cumsum(lengths.sum(axis=1))]), out


def format_turns(roles: pa.Array, texts: pa.Array, template: Template) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(formatted turns as large_string, code points of header, code points of the escaped text) by row."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    pattern = "|".join(rf"({re.escape(c[0])})(\\*{re.escape(c[1:])})" for c in template.controls)
    held = pc.match_substring_regex(texts, pattern)
    if pc.any(held).as_py():  # only rows that hold a control string become Python strings
        texts = pc.replace_with_mask(texts, held, pa.array([template.escape(t) for t in texts.filter(held).to_pylist()], pa.large_string()))
    coded = pc.fill_null(roles.cast(pa.string()), "").dictionary_encode()
    pairs = [template.segments(r) for r in coded.dictionary.to_pylist()]
    heads, tails = (pa.array([p[k] for p in pairs], pa.large_string()).take(coded.indices) for k in (0, 1))
    offsets, data = assemble([heads, texts, tails])
    made = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return made, pc.utf8_length(heads).to_numpy(), pc.utf8_length(texts).to_numpy()


SCHEMA = "conv_id bigint, formatted string, spans array<struct<start:bigint,length:bigint>>"
MOST_BYTES = (1 << 31) - 1  # of one Arrow string column


def _conversations(ids: pa.Array, offsets: np.ndarray, data: pa.Buffer, first: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of conversations whose bytes lie one after another in `data`: at offsets, their spans from first[i] to first[i + 1]."""
    a = 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + MOST_BYTES, side="right")) - 1)
        b = min(b, len(ids))
        values = data.slice(int(offsets[a]), int(offsets[b] - offsets[a]))
        texts = pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer((offsets[a : b + 1] - offsets[a]).astype(np.int32)), values])
        inner = pa.StructArray.from_arrays([pa.array(x[first[a] : first[b]]) for x in (starts, lengths)], names=["start", "length"])
        spans = pa.ListArray.from_arrays(pa.array((first[a : b + 1] - first[a]).astype(np.int32)), inner)
        yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), texts, spans], names=["conv_id", "formatted", "spans"])
        a = b


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted, spans) of turns (conv_id, turn, role, text); spans are where loss counts, in code points.

    Rows go by turn (null first), then role and text, so repeated rows and ties have one order. Null texts and
    roles are empty; rows with a null conv_id are one conversation. Partitions are by conversation, sorted, and
    read as a stream. Conversations are runs of turns in the buffer that turns were assembled in, which is the
    result's own; only one that goes on past a batch is kept aside and joined. Memory holds a batch and the
    conversation being written, which is one output value. An empty table gives no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # of the conversation that may go on: its id, then (bytes, span starts, span lengths, code points)

        def release() -> Iterator[pa.RecordBatch]:
            if held:
                (name, *parts), before = held, 0
                starts = []
                for _, s, _, points in parts:
                    starts.append(s + before)
                    before += points
                data = pa.py_buffer(b"".join(p[0] for p in parts))
                starts, lengths = np.concatenate(starts), np.concatenate([p[2] for p in parts])
                yield from _conversations(name, np.array([0, data.size]), data, np.array([0, len(starts)]), starts, lengths)
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            made, heads, bodies = format_turns(batch.column(2), batch.column(3), template)
            bytes_at, data = np.frombuffer(made.buffers()[1], np.int64), made.buffers()[2]
            points = np.concatenate([[0], np.cumsum(pc.utf8_length(made).to_numpy())])
            ids = batch.column(0)
            known, values = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]) | (known[1:] != known[:-1])])
            stops = np.r_[starts[1:], len(ids)]
            counts = np.flatnonzero(pc.equal(pc.fill_null(batch.column(2), ""), "assistant").to_numpy(zero_copy_only=False))
            owner = np.searchsorted(starts, counts, side="right") - 1
            span_at, span_n = points[counts] - points[starts[owner]] + heads[counts], bodies[counts].astype(np.int64)
            first = np.searchsorted(owner, np.arange(len(starts) + 1))

            def part(c: int) -> tuple:
                a, b = int(bytes_at[starts[c]]), int(bytes_at[stops[c]])
                return data.slice(a, b - a).to_pybytes(), span_at[first[c] : first[c + 1]], span_n[first[c] : first[c + 1]], int(points[stops[c]] - points[starts[c]])

            done = 0
            if held and held[0][0].as_py() == ids[0].as_py():
                held.append(part(0))
                done = 1
            if done < len(starts):
                yield from release()
                last = len(starts) - 1
                yield from _conversations(ids.take(pa.array(starts[done:last])), bytes_at[starts[done : last + 1]], data, first[done : last + 1], span_at, span_n)
                held += [ids.slice(int(starts[last]), 1), part(last)]
        yield from release()

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the formatted text and spans alone.

    A row for every row, repeated ones too; an empty table gives no rows; extra columns, whatever their names, are
    ignored. Conversations of any length are read whole, one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c, text, spans in ((batch.column(k)[n].as_py() for k in range(3)) for n in range(batch.num_rows)):
                turns = template.parse(text)
                whole = "".join(f"{role}\n{t}\n" for role, t, _, _ in turns)
                loss = "".join(template.unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans)
                rows.append((c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = zip(*rows) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
