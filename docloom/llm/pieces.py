"""SentencePiece encoding and decoding by suffix-array matching.

The distinct stretches of a batch (a run of spaces and what follows up to the next one; no piece spans
two) are concatenated and their suffixes sorted by the first eight bytes. Binary search gives the
occurrence range of every piece, longer pieces are compared to their end, and the occurrences become
edges sorted by where they end. Relaxing them from left to right keeps for every position the last
piece of the prefix: an edge is taken when the piece before it and its own piece stay apart, that is,
when merging their letters in order of the scores never joins across them. Exactly one edge at each
position does, so the path equals the merge result of the model. Letters that no piece holds become
byte pieces.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Spans, gathered, give_back, in_small_batches, text_bytes

SPACE_MARK = "▁"
#: Text bytes handled at once, and bytes of distinct stretches matched at once; memory follows these, not the texts.
BATCH_BYTES, MATCH_BYTES = 2 << 20, 1 << 20
UNKNOWN, START, UNSET = 0, -1, -2
NEVER = np.iinfo(np.int32).max


class Model:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        kinds = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        texts = ["" if kinds[i] else model.id_to_piece(i).replace(SPACE_MARK, " ") for i in range(n)]
        self.first_byte = next(i for i in range(n) if model.is_byte(i))
        self.ids = np.array([i for i in range(n) if not kinds[i]], np.int32)
        self.raw = [texts[i].encode() for i in self.ids]
        self.bytes = [bytes([i - self.first_byte]) if model.is_byte(i) else texts[i].encode() for i in range(n)]
        self.length = np.array([len(b) for b in self.bytes], np.int32)
        self.rank(texts, [model.get_score(i) for i in range(n)])
        padded = [np.frombuffer(b[:8].ljust(8, fill), ">u8")[0] for b in self.raw for fill in (b"\0", b"\xff")]
        self.low, self.high = np.array(padded[::2], np.uint64), np.array(padded[1::2], np.uint64)
        self.pairs, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)

    def rank(self, texts: list[str], scores: list[float]) -> None:
        """When each piece is made by merging, and from which two; the order of merges is that of the scores."""
        by_text = {t: i for i, t in enumerate(texts) if t}
        order = sorted((i for i, t in enumerate(texts) if len(t) > 1), key=lambda i: (-scores[i], i))
        n = len(texts)
        self.made = np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.made[order] = np.arange(len(order))
        time, self.reached = self.made, np.array([len(t) == 1 for t in texts])
        self.partners: dict[int, int] = {}
        for i in order:
            parts = [by_text.get(c, -1) for c in texts[i]]
            whole = True
            while len(parts) > 1:  # merge the letters of the piece
                best, at = NEVER, -1
                for k in range(len(parts) - 1):
                    a, b = parts[k], parts[k + 1]
                    joined = by_text.get(texts[a] + texts[b], -1) if a >= 0 and b >= 0 else -1
                    if joined >= 0 and time[joined] < best:
                        best, at = time[joined], k
                if at < 0:
                    whole = False
                    break
                if len(parts) == 2:
                    self.left[i], self.right[i] = parts
                parts[at : at + 2] = [by_text[texts[parts[at]] + texts[parts[at + 1]]]]
            self.reached[i] = whole
        keys, values = [], []
        for text, i in by_text.items():  # every way to cut a piece into two
            for k in range(1, len(text)):
                a, b = by_text.get(text[:k]), by_text.get(text[k:])
                if a is not None and b is not None:
                    keys.append(a * n + b), values.append(time[i])
        order = np.argsort(keys)
        self.join_keys, self.join_times, self.n = np.array(keys)[order], np.array(values)[order], n
        depth = 0
        edge = [np.arange(n), np.arange(n)]  # outermost letters: last of the piece before, first of the one after
        while True:
            nexts = [np.where(side[e] >= 0, side[e], e) for e, side in zip(edge, (self.right, self.left))]
            if all((a == b).all() for a, b in zip(edge, nexts)):
                break
            edge, depth = nexts, depth + 1
        self.last_letter, self.first_letter = edge

    def join_time(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
        return np.where(self.join_keys[at] == key, self.join_times[at], NEVER)

    def climb(self, piece: np.ndarray, part: np.ndarray, side: np.ndarray) -> np.ndarray:
        """The part of ``piece`` just above its outer part ``part``; -1 above the piece itself."""
        out, now = np.full(len(piece), -1), piece.copy()
        open_ = now != part
        while open_.any():
            k = np.flatnonzero(open_)
            below = side[now[k]]
            hit = below == part[k]
            out[k[hit]] = now[k[hit]]
            now[k] = below
            open_[k] = ~hit & (below >= 0)
        return out

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the letters of two neighbouring pieces in order gives the two pieces."""
        fine = self.reached[a] & self.reached[b]
        l, r = self.last_letter[a], self.first_letter[b]
        open_ = np.flatnonzero(fine)
        while len(open_):
            x, y = l[open_], r[open_]
            up_x, up_y = self.climb(a[open_], x, self.right), self.climb(b[open_], y, self.left)
            end_x = np.where(up_x >= 0, self.made[up_x], NEVER)
            end_y = np.where(up_y >= 0, self.made[up_y], NEVER)
            join = np.maximum(self.join_time(x, y), np.maximum(self.made[x], self.made[y]))
            none = self.join_time(x, y) == NEVER
            # equal times go to the merge further left
            crossed = ~none & (join < end_x) & (join <= end_y)
            fine[open_[crossed]] = False
            first = end_x <= end_y
            moved = ~crossed & ((up_x >= 0) | (up_y >= 0))
            l[open_] = np.where(moved & first & (up_x >= 0), up_x, x)
            r[open_] = np.where(moved & ~first & (up_y >= 0), up_y, y)
            open_ = open_[moved]
        return fine

    def known_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        ask = np.unique(key)
        at = np.minimum(np.searchsorted(self.pairs, ask), max(0, len(self.pairs) - 1))
        new = ask[self.pairs[at] != ask] if len(self.pairs) else ask
        if len(new):
            if len(self.pairs) > 4_000_000:  # only a memory of answers; it may start anew
                self.pairs, self.apart, new = np.zeros(0, np.int64), np.zeros(0, bool), ask
            keys = np.r_[self.pairs, new]
            order = np.argsort(keys, kind="stable")
            self.apart = np.r_[self.apart, self.stay_apart(new // self.n, new % self.n)][order]
            self.pairs = keys[order]
        return self.apart[np.searchsorted(self.pairs, key)]

    def edges(self, data: np.ndarray):
        """Start byte and piece of every occurrence of a piece in ``data``."""
        n = len(data)
        padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        key = np.zeros(len(heads), np.uint64)
        for k in range(8):
            key = key << np.uint64(8) | padded[heads + k]
        order = np.argsort(key)
        suffixes, key = heads[order].astype(np.int32), key[order]
        a, b = np.searchsorted(key, self.low), np.searchsorted(key, self.high, "right")
        size = b - a
        at, piece = [], []
        short = np.array([len(r) <= 8 for r in self.raw])
        take = np.where(short, size, 0)
        total = np.r_[0, np.cumsum(take)]
        at.append(suffixes[np.arange(total[-1]) + np.repeat(a - total[:-1], take)])
        piece.append(np.repeat(self.ids, take))
        for k in np.flatnonzero(~short & (size > 0)):
            rest = np.frombuffer(self.raw[k][8:], np.uint8)
            found = suffixes[a[k] : b[k]]
            found = found[found + 8 + len(rest) <= n]
            same = (data[found[:, None] + 8 + np.arange(len(rest))] == rest).all(1) if len(found) else np.zeros(0, bool)
            at.append(found[same]), piece.append(np.full(int(same.sum()), self.ids[k], np.int32))
        return np.concatenate(at), np.concatenate(piece)

    def stretches(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each stretch, and their offsets."""
        size = np.array([len(p) for p in pieces], np.int64)
        begin = np.r_[0, np.cumsum(size + 1)][:-1]  # a zero byte behind each; no piece holds one
        data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8) if pieces else np.zeros(0, np.uint8)
        start, piece = self.edges(data)
        length = self.length[piece]
        # letters without a piece of their own
        heads = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
        wide = np.diff(np.r_[heads, np.int32(len(data))])
        lone = np.ones(len(data), bool)
        lone[start[self.made[piece] < 0]] = False
        lone[begin + size] = False
        alone = lone[heads]
        start = np.r_[start, heads[alone]]
        piece = np.r_[piece, np.full(int(alone.sum()), UNKNOWN, np.int32)]
        length = np.r_[length, wide[alone]]
        far = (start + length - begin[np.searchsorted(begin, start, "right") - 1]).astype(np.int32)
        order = np.argsort(far.astype(np.uint16) if len(far) and far.max() < 65536 else far, kind="stable")
        start, piece, length, far = start[order], piece[order], length[order], far[order]
        last, came = np.full(len(data) + 1, UNSET), np.zeros(len(data) + 1, np.int64)
        last[begin] = START
        cut = np.r_[0, np.flatnonzero(np.diff(far)) + 1, len(far)]
        for lo, hi in zip(cut[:-1], cut[1:]):
            s, t = start[lo:hi], piece[lo:hi]
            before = last[s]
            fine = (before == START) | ((before == UNKNOWN) | (t == UNKNOWN)) & (before != UNSET)
            ask = np.flatnonzero(~fine & (before >= 0))
            fine[ask] = self.known_apart(before[ask], t[ask])
            fine &= self.reached[t] | (t == UNKNOWN)
            e = s[fine] + length[lo:hi][fine]
            last[e], came[e] = t[fine], s[fine]
        # walk back from the ends
        now, row, got = begin + size, np.arange(len(pieces)), []
        while len(row):
            t, s = last[now], came[now]
            plain = t != UNKNOWN
            got.append((row[plain], s[plain], t[plain]))
            for k in np.flatnonzero(~plain):
                w = data[s[k] : now[k]].astype(np.int64)
                got.append((np.full(len(w), row[k]), s[k] + np.arange(len(w)), self.first_byte + w))
            more = s > begin[row]
            now, row = s[more], row[more]
        rows, places, ids = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 3
        order = np.argsort(places, kind="stable")
        return ids[order].astype(np.int32), np.r_[0, np.cumsum(np.bincount(rows, minlength=len(pieces)))]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts (null: empty) and the offsets of each text's."""
        array = texts.fill_null("")
        if any(pc_any(array, SPACE_MARK)):
            array = pa.array([t.replace(SPACE_MARK, " ") for t in array.to_pylist()], array.type)
        raw, offsets = text_bytes(array)
        n = len(offsets) - 1
        filled = np.diff(offsets) > 0
        # one space before each text that is not empty
        shift = np.cumsum(filled)
        data = np.full(len(raw) + int(filled.sum()), 32, np.uint8)
        data[np.arange(len(raw)) + np.repeat(shift, np.diff(offsets))] = raw
        offsets = offsets + np.r_[0, shift]
        space = data == 32
        cut = np.zeros(len(data) + 1, bool)
        cut[1 : len(data)] = space[1:] & ~space[:-1]
        cut[offsets] = True
        border = np.flatnonzero(cut[: len(data)])
        spans = Spans(data, offsets, border, np.r_[border[1:], len(data)] if len(border) else border)
        _, first, inverse = np.unique(spans.hashes[0], return_index=True, return_inverse=True)
        flat = data.tobytes()
        begin, end = spans.start[first], spans.end[first]
        group = np.cumsum(end - begin) // MATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(first)]
        found = [
            self.stretches([flat[a:b] for a, b in zip(begin[lo:hi].tolist(), end[lo:hi].tolist())]) for lo, hi in zip(cuts[:-1], cuts[1:])
        ]
        counts = np.concatenate([np.diff(at) for _, at in found])
        out, ends = gathered(np.concatenate([ids for ids, _ in found]), np.r_[0, np.cumsum(counts)], inverse)
        return out, ends[spans.first]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each text; control and unknown ids add nothing."""
        flat, at = np.frombuffer(b"".join(self.bytes), np.uint8), np.r_[0, np.cumsum(self.length)]
        data, ends = gathered(flat, at, ids.astype(np.int64))
        raw, cuts = data.tobytes(), ends[offsets]
        return [raw[a + 1 if raw[a : a + 1] == b" " else a : b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def pc_any(array: pa.Array, mark: str):
    return [bool(pc.any(pc.match_substring(array, mark)).as_py())] if len(array) else [False]


@lru_cache(1)
def shared_model(path: str) -> Model:
    return Model(path)


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """``doc, n_pieces, ids, ids_crc32, exact`` of every row, in the order that the model's merges give.

    ``exact`` tells whether decoding the ids gives the text back, which only the space mark itself
    prevents. Null and empty texts have no pieces; rows with null or repeated keys are encoded like all
    others; an empty table gives no rows; other columns are not read.
    """
    import zlib

    rows = in_small_batches(docs).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))

    def run(batches):
        model = shared_model(path)
        for whole in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, "right")))
                batch = whole.slice(at, to - at)
                at = to
                ids, ends = model.encode(batch.column("text"))
                back = model.decode(ids, ends)
                raw = ids.astype("<u4")
                texts = batch.column("text").fill_null("").to_pylist()
                columns = {
                    "doc": batch.column("doc"),
                    "n_pieces": pa.array(np.diff(ends)),
                    "ids_crc32": pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])], pa.int64()),
                    "exact": pa.array([t.encode() == b for t, b in zip(texts, back)]),
                }
                if keep_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_pydict(columns)
                give_back()

    schema = "doc long, n_pieces long, ids_crc32 long, exact boolean" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(run, schema)
