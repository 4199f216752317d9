"""Texts as numpy columns: word borders, word hashes and hashes of word windows.

A word hash is a polynomial over table values of its bytes, taken from prefix sums, so the cost
does not depend on word lengths. Multiplications wrap modulo 2**64 and the odd base has an
inverse there, which makes a hash independent of where the word stands. A finishing mix spreads
the bits. Two seeds give two independent hashes.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text bytes that are hashed at once; one longer text is taken alone.
PIECE = (1 << 19) - 1
#: Bytes that Spark hands to Python at once, where the session names no number of its own.
ARROW_BYTES = 4 << 20
ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session set to move rows to Python in batches of few bytes.

    A batch stands several times outside the heap of an executor; with long texts the usual number of
    rows a batch takes hundreds of MB a task. Groups still arrive whole, as tables of several chunks.
    """
    conf = df.sparkSession.conf
    if conf.get(ARROW_SETTING, None) is None:
        conf.set(ARROW_SETTING, str(ARROW_BYTES))
    return df


def give_back() -> None:
    """Return freed memory to the system; workers stay alive between tasks and others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 40, 1 << 62)) * 2 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (
                np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)])
                for b in (self.base, self.inverse)
            )
        return self.up[:n], self.down[:n]


SEEDS: dict[int, Powers] = {}


def powers(seed: int) -> Powers:
    if seed not in SEEDS:
        SEEDS[seed] = Powers(seed)
    return SEEDS[seed]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the n + 1 offsets of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    array = column.cast(pa.large_binary()).fill_null(b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a column of texts.

    ``start``/``end``: byte borders in ``data``; ``first``: n + 1 offsets of each text's words;
    ``hashes``: one array of word hashes for every seed asked for.
    """

    def __init__(self, column, lower: bool = False, seeds=(1,), space: np.ndarray = SPACE):
        self.data, self.offsets = text_bytes(column)
        if lower:
            self.data = LOWER[self.data]
        inside = ~space[self.data]
        border = np.zeros(len(self.data) + 1, bool)
        border[self.offsets] = True
        before = np.r_[False, inside[:-1]] if len(inside) else inside
        after = np.r_[inside[1:], False] if len(inside) else inside
        self.start = np.flatnonzero(inside & (~before | border[:-1]))
        self.end = np.flatnonzero(inside & (~after | border[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.hashes = [self.hashed(powers(s)) for s in seeds]

    def __len__(self) -> int:
        return len(self.start)

    def hashed(self, p: Powers) -> np.ndarray:
        out = np.empty(len(self), np.uint64)
        lo, n = 0, len(self.offsets) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.offsets, self.offsets[lo] + PIECE, "right")) - 1)
            a, b = self.first[lo], self.first[hi]
            base, top = self.offsets[lo], self.offsets[hi]
            up, down = p.to(int(top - base) + 1)
            sums = np.zeros(int(top - base) + 1, np.uint64)
            np.cumsum(p.table[self.data[base:top]] * up[:-1], out=sums[1:])
            s, e = self.start[a:b] - base, self.end[a:b] - base
            out[a:b] = (sums[e] - sums[s]) * down[s]
            lo = hi
        return mixed(out)

    @property
    def text_of(self) -> np.ndarray:
        """Number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def windows(hashes: np.ndarray, first: np.ndarray, width: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within one text, and the word each run starts at.

    Runs are polynomials over word hashes, doubled in length and extended by one as the bits of
    ``width`` say.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    base = powers(seed).base
    run, length = hashes, 1
    for bit in bin(width)[3:]:
        run = run[: len(run) - length] * np.uint64(pow(base, length, 1 << 64)) + run[length:]
        length *= 2
        if bit == "1":
            run = run[: len(run) - 1] * np.uint64(base) + hashes[length:]
            length += 1
    open_ = np.ones(n, bool)
    for k in range(1, width):  # runs that would leave their text
        at = first[1:] - k
        open_[at[at >= first[:-1]]] = False
    at = np.flatnonzero(open_)
    return mixed(run[at]), at


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run of ``width`` words that starts at one of ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:-1]) > 0


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned values, stored byte by byte: like bytes lie together and pack well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data, width: int, offset: int = 0, count: int = -1) -> np.ndarray:
    """The values that ``planes`` stored, as 64-bit unsigned integers."""
    flat = np.frombuffer(data, np.uint8, count * width if count >= 0 else -1, offset)
    n = len(flat) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = flat.reshape(width, n).T
    return out.reshape(-1).view("<u8")


class Spans(Words):
    """Hashes of given byte spans, in order, none of which leaves its text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.offsets, self.start, self.end = data, offsets, start, end
        self.first = np.searchsorted(start, offsets)
        self.hashes = [self.hashed(powers(1))]


def gathered(values: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``chosen`` of a ragged array, one after the other, and their new offsets."""
    size = np.diff(offsets)[chosen]
    new = np.r_[0, np.cumsum(size)]
    return values[np.arange(new[-1]) + np.repeat(offsets[:-1][chosen] - new[:-1], size)], new
