"""Chat formatting by columnar byte assembly.

Lengths of all segments of some rows (marks, roles, texts) give cumulative offsets, and one scatter of
bytes into a preallocated buffer writes all of them. The buffer is the data of an Arrow column as it is; the offsets
at which conversations begin are the column's offsets.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that mark turns here or in other templates; inside texts they are escaped.
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
OPEN, CLOSE = b"<|im_start|>", b"<|im_end|>\n"
RESTS = "|".join(re.escape(c[1:]) for c in CONTROL)
ESCAPE = re.compile(rf"([<\[])(\\*)({RESTS})")
UNESCAPE = re.compile(rf"([<\[])\\(\\*)({RESTS})")
TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
FORMATTED = "conv_id long, part int, formatted binary, loss_starts array<long>, loss_ends array<long>"
#: A conversation goes on in a next part after so many bytes; rows and text bytes assembled at once.
PART_BYTES, ROWS, ROWS_BYTES = 32 << 20, 4096, 64 << 20


def escaped(text: str) -> str:
    """A backslash behind the first letter of each control string; those that have some get one more."""
    return ESCAPE.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def role_name(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_text(name: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(name))


def safe_texts(column: pa.Array) -> pa.Array:
    """Texts with control strings escaped; only texts that hold one leave Arrow."""
    column = column.fill_null("")
    marked = pc.match_substring_regex(column, rf"[<\[]\\*({RESTS})").to_numpy(zero_copy_only=False)
    if not marked.any():
        return column
    out = column.to_pylist()
    for k in np.flatnonzero(marked):
        out[k] = escaped(out[k])
    return pa.array(out, column.type)


def assembled(segments: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of row-wise concatenated segments, and the offsets of all segments, row by row.

    A segment is ``(bytes, offsets of its rows)``.
    """
    lengths = np.stack([np.diff(o) for _, o in segments], axis=1)
    ends = np.cumsum(lengths.reshape(-1))
    offsets = np.r_[0, ends]
    buffer = np.empty(int(offsets[-1]), np.uint8)
    starts = offsets[:-1].reshape(lengths.shape)
    for k, (data, own) in enumerate(segments):
        n = lengths[:, k]
        shift = np.repeat(starts[:, k] - own[:-1], n)
        buffer[np.arange(own[0], own[-1]) + shift] = data[own[0] : own[-1]]
    return buffer, offsets


def constant(value: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.tile(np.frombuffer(value, np.uint8), n), np.arange(n + 1) * len(value)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    from .arrays import text_bytes

    return text_bytes(column)


def formatted(rows: pa.RecordBatch, loss_role: str, first_part: int) -> pa.RecordBatch:
    """One row per conversation of ``rows``, in their order; the first one is its part ``first_part``."""
    n, ids = rows.num_rows, rows.column("conv_id").to_pylist()
    said = rows.column("role").to_pylist()
    roles = pa.array([role_name(r or "") for r in said], pa.string())
    segments = [constant(OPEN, n), bytes_of(roles), constant(b"\n", n), bytes_of(safe_texts(rows.column("text"))), constant(CLOSE, n)]
    buffer, offsets = assembled(segments)
    begin = np.array([0, *(k for k in range(1, n) if ids[k] != ids[k - 1])])
    own = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, n]))
    at = offsets[5 * np.r_[begin, n]]
    learnt = np.flatnonzero(np.array([r == loss_role for r in said], bool))
    masks = np.r_[0, np.cumsum(np.bincount(own[learnt], minlength=len(begin)))].astype(np.int32)
    spans = [pa.ListArray.from_arrays(pa.array(masks), pa.array(offsets[k::5][learnt] - at[own[learnt]])) for k in (3, 4)]
    text = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(buffer)])
    part = np.zeros(len(begin), np.int32)
    part[0] = first_part
    return pa.RecordBatch.from_arrays([rows.column("conv_id").take(pa.array(begin)), pa.array(part), text, *spans], [c.split()[0] for c in FORMATTED.split(", ")])


def weight(rows: pa.RecordBatch) -> np.ndarray:
    """About the formatted bytes of each row."""
    length = lambda c: pc.fill_null(pc.binary_length(rows.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return length("text") + length("role") + len(OPEN) + 1 + len(CLOSE)


def format_sorted(batches, loss_role: str):
    """Batches of turns sorted by conversation and turn; a conversation may span batches.

    The rows of the last conversation wait for those of the next batch, until they weigh a part.
    """
    held, going, name, part = None, False, None, 0  # waiting rows; whether a conversation was cut, which and in which part

    def emit(rows: pa.RecordBatch, cut: bool):
        nonlocal going, name, part
        ids = rows.column("conv_id")
        out = formatted(rows, loss_role, part + 1 if going and ids[0].as_py() == name else 0)
        going, name, part = cut, ids[-1].as_py(), out.column("part")[-1].as_py()
        return out

    for whole in batches:
        sizes, at = np.cumsum(weight(whole)), 0
        while at < whole.num_rows:
            to = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + ROWS_BYTES, "right"))
            to = min(max(at + 1, to), at + ROWS, whole.num_rows)
            rows = whole.slice(at, to - at)
            at = to
            rows = rows if held is None else pa.concat_batches([held, rows])
            ids = rows.column("conv_id").to_pylist()
            last = rows.num_rows - 1
            while last and ids[last - 1] == ids[-1]:
                last -= 1
            if weight(rows.slice(last)).sum() > PART_BYTES:
                held = None
                yield emit(rows, cut=True)
                continue
            held = rows.slice(last)
            if last:
                yield emit(rows.slice(0, last), cut=False)
    if held is not None:
        yield emit(held, cut=False)


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, part, formatted, loss_starts, loss_ends``: text of each conversation and byte spans to learn.

    Rows are sorted by turn, ties by role and text; null roles and texts count as empty; a null conv_id is one
    more conversation. Repeated rows are turns of their own. A very long conversation streams through its
    task and comes in parts of about 32 MB, cut between turns. An empty table gives no rows; other columns
    are not read.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(lambda batches: format_sorted(batches, loss_role), FORMATTED)


def read_back(batches):
    """Digests of formatted conversations, parts in order: parsed, unescaped, and what the mask covers."""
    held = None

    def row():
        return {
            "conv_id": held[0], "n_turns": held[1], "turns_sha256": held[2].hexdigest(), "loss_chars": held[3],
            "loss_sha256": held[4].hexdigest(), "formatted_chars": held[5],
        }

    names = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    for batch in batches:
        done = []
        for part in batch.to_pylist():
            if held is None or part["part"] == 0:
                if held is not None:
                    done.append(row())
                held = [part["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            data = part["formatted"]
            held[5] += len(data.decode())
            for m in TURN.finditer(data):
                held[1] += 1
                held[2].update(f"{role_text(m[1].decode())}\n{unescaped(m[2].decode())}\n".encode())
            for a, b in zip(part["loss_starts"], part["loss_ends"]):
                text = unescaped(data[a:b].decode())
                held[3] += len(text)
                held[4].update(text.encode())
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema(names))
    if held is not None:
        yield pa.RecordBatch.from_pylist([row()], pa.schema(names))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def chat_digest(turns: DataFrame) -> DataFrame:
    """One row for each conversation, from the formatted parts as they come, in order within a partition."""
    return format_conversations(turns).mapInArrow(read_back, DIGEST)
