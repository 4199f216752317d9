"""Removal of word sequences that occur more than once in a corpus.

Anchors are the non-overlapping blocks of ``(window + 1) // 2`` words of each text: every window
holds a whole one. All rolling runs of that length are probes. A run that occurs at two places,
one of them an anchor, is a hit, and only windows around a hit can repeat. Their whole word
sequences are compared next, so neighbouring windows extend a hit to its maximal exact repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from . import exchange as X
from .arrays import Words, covered, from_planes, planes, windows

SPANS = "row_key long, doc long, text string, n_words long, starts array<int>, ends array<int>"


def probes(words: Words, anchor: int):
    """Sorted distinct probe hashes, their flags (1: at two places, 2: an anchor), and where they stand."""
    hashes, at = windows(words.hashes[0], words.first, anchor)
    aligned = (at - np.repeat(words.first[:-1], np.diff(words.first))[at]) % anchor == 0
    distinct, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    flags = (counts > 1).astype(np.uint8)
    flags[inverse[aligned]] |= 2
    return distinct, flags, inverse, at


def low_bits(hashes: np.ndarray) -> np.ndarray:
    """Bits 8 to 31 of a hash, which the bucket number does not depend on."""
    return (hashes >> np.uint64(8)) & np.uint64(0xFFFFFF)


class RepeatFinder:
    """The passes over a block; everything here is a pure function of its rows and the answers.

    Probe hashes keep 24 bits within a bucket sized for 400,000 of them, so a probe is taken for a hit
    by mistake about once in 1,000; whole windows are then compared by 64 bits within buckets that a
    second, independent hash chooses, so this comparison sharpens as buckets grow in number.
    """

    def __init__(self, window: int, buckets: int, extra: dict[str, pa.DataType] | None = None):
        self.window, self.anchor, self.buckets, self.extra = window, (window + 1) // 2, buckets, extra or {}

    def words(self, rows: pa.Table) -> Words:
        return Words(rows.column("text"), seeds=(1, 2))

    def ask_probes(self, rows: pa.Table) -> pa.Table:
        distinct, flags, _, _ = probes(self.words(X.ordered(rows)), self.anchor)
        parts = []
        for bucket, a, b in X.split(distinct, self.buckets):
            low = low_bits(distinct[a:b])
            order = np.argsort(low, kind="stable")
            steps = np.diff(low[order], prepend=np.uint64(0))
            two_bits = np.unpackbits(flags[a:b][order, None], axis=1)[:, 6:]
            parts.append((bucket, X.counted(b - a) + planes(steps, 3) + np.packbits(two_bits).tobytes()))
        return X.questions(rows.column("block")[0].as_py(), parts)

    @staticmethod
    def parse_probes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = X.count_of(data)
        low = np.cumsum(from_planes(data, 3, 4, n))
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -1, 4 + 3 * n), count=2 * n).reshape(-1, 2)
        return low, bits[:, 0] * 2 + bits[:, 1]

    def answer_probes(self, asked: pa.Table) -> pa.Table:
        seen = np.zeros(1 << 24, np.uint8)  # 0 unseen, 1 once, 2 more often; 4 an anchor
        parsed = [self.parse_probes(q.as_py()) for q in asked.column("question")]
        for low, flags in parsed:
            twice = np.r_[low[1:] == low[:-1], False] | np.r_[False, low[1:] == low[:-1]]
            anchors, many = low[flags & 2 > 0], low[(flags & 1 > 0) | twice]
            before = seen[low]
            seen[low] = np.where(before & 3, before | 2, before | 1)
            seen[many] |= 2
            seen[anchors] |= 4
        return X.answers(asked, (np.packbits((seen[low] & 6) == 6).tobytes() for low, _ in parsed))

    def candidates(self, words: Words, told: dict[int, bytes]):
        """Whole windows around hits: their hash, their bucket and the words they start at."""
        distinct, _, inverse, at = probes(words, self.anchor)
        hit = np.zeros(len(distinct), bool)
        for bucket, a, b in X.split(distinct, self.buckets):
            order = np.argsort(low_bits(distinct[a:b]), kind="stable")
            hit[a + order] = np.unpackbits(np.frombuffer(told[bucket], np.uint8), count=b - a).astype(bool)
        places = at[hit[inverse]]
        back = self.window - self.anchor
        near = covered(np.maximum(places - back, 0), back + 1, len(words))
        full, start = windows(words.hashes[0], words.first, self.window)
        other, _ = windows(words.hashes[1], words.first, self.window, seed=8)
        chosen = near[start]
        return full[chosen], X.bucket_of(other[chosen], self.buckets), start[chosen]

    @staticmethod
    def grouped(full: np.ndarray, bucket: np.ndarray):
        """Distinct windows by bucket and hash, how often each stands here, and the way back."""
        order = np.lexsort((full, bucket))
        f, b = full[order], bucket[order]
        new = np.r_[True, (f[1:] != f[:-1]) | (b[1:] != b[:-1])] if len(f) else np.zeros(0, bool)
        group = np.empty(len(f), np.int64)
        group[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        return f[at], b[at], np.diff(np.r_[at, len(f)]), group

    @staticmethod
    def pieces(bucket: np.ndarray):
        cut = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
        return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:]) if b > a]

    def ask_windows(self, rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return X.questions(0, [])
        full, bucket, _ = self.candidates(self.words(X.ordered(rows)), X.by_bucket(told))
        hashes, buckets, counts, _ = self.grouped(full, bucket)
        many = counts > 1
        return X.questions(
            rows.column("block")[0].as_py(),
            [
                (k, X.counted(b - a) + planes(hashes[a:b], 8) + np.packbits(many[a:b]).tobytes())
                for k, a, b in self.pieces(buckets)
            ],
        )

    def answer_windows(self, asked: pa.Table) -> pa.Table:
        parsed = []
        for q in asked.column("question"):
            data = q.as_py()
            n = X.count_of(data)
            many = np.unpackbits(np.frombuffer(data, np.uint8, -1, 4 + 8 * n), count=n).astype(bool)
            parsed.append((from_planes(data, 8, 4, n), many))
        every = np.concatenate([h for h, _ in parsed])
        distinct, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
        repeated = counts > 1
        repeated[inverse[np.concatenate([m for _, m in parsed])]] = True
        out, at = [], 0
        for h, _ in parsed:
            out.append(np.packbits(repeated[inverse[at : at + len(h)]]).tobytes())
            at += len(h)
        table = X.answers(asked, out)
        return table.set_column(1, "bucket", pa.array([-1 - b for b in table.column("bucket").to_pylist()], pa.int32()))

    def spans(self, rows: pa.Table, told: pa.Table) -> pa.Table:
        """Rows of a block with the byte spans of the words to remove."""
        if not rows.num_rows:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            names = ("row_key", "doc", "text", "n_words", "starts", "ends")
            return pa.schema([*zip(names, kinds), *self.extra.items()]).empty_table()
        rows = X.ordered(rows)
        words, replies = self.words(rows), X.by_bucket(told)
        full, bucket, start = self.candidates(words, {k: v for k, v in replies.items() if k >= 0})
        _, buckets, _, group = self.grouped(full, bucket)
        repeated = np.zeros(len(buckets), bool)
        for k, a, b in self.pieces(buckets):
            repeated[a:b] = np.unpackbits(np.frombuffer(replies[-1 - k], np.uint8), count=b - a)
        gone = covered(start[repeated[group]], self.window, len(words))
        of = words.text_of
        left = words.offsets[of]
        # runs of removed words, one text at a time
        edge = np.r_[True, of[1:] != of[:-1]] if len(of) else np.zeros(0, bool)
        opens = gone & (edge | ~np.r_[False, gone[:-1]]) if len(of) else gone
        closes = gone & (np.r_[edge[1:], True] | ~np.r_[gone[1:], False]) if len(of) else gone
        offsets = np.r_[0, np.cumsum(np.bincount(of[opens], minlength=rows.num_rows))].astype(np.int32)
        lists = [
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32)))
            for x in (words.start[opens] - left[opens], words.end[closes] - left[closes])
        ]
        return pa.table(
            {
                "row_key": rows.column("row_key"),
                "doc": rows.column("doc").cast(pa.int64()),
                "text": rows.column("text").cast(pa.string()),
                "n_words": pa.array(np.diff(words.first)),
                "starts": lists[0],
                "ends": lists[1],
                **{c: rows.column(c).cast(kind) for c, kind in self.extra.items()},
            }
        )


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, then=None, schema: str = SPANS, extra=()) -> DataFrame:
    """``doc, text, n_words, starts, ends``: the maximal byte runs of words that repeated windows cover.

    A window is ``window`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one text; it repeats when the
    same words also start anywhere else, in the same text included. Windows are judged on the input.
    Null texts count as empty; empty texts and texts shorter than a window have no spans; repeated
    rows repeat each other; an empty table gives an empty result; other columns are not read.
    ``then`` turns the rows of a block into those of ``schema`` where they are found, so that texts
    pass through Python once; it also gets the columns ``extra`` of each row.
    """
    if window < 2:
        raise ValueError("a window has at least two words")
    blocks, _, size = X.text_blocks(docs, key, text, extra=extra)
    finder = RepeatFinder(window, max(1, size // 7 // X.BUCKET_HASHES), {c: to_arrow_type(docs.schema[c].dataType) for c in extra})
    hits = X.answer(X.ask(blocks, finder.ask_probes), finder.answer_probes)
    whole = X.answer(X.told(blocks, hits, finder.ask_windows, X.ASKED), finder.answer_windows)
    last = (lambda rows, told: then(finder.spans(rows, told))) if then else finder.spans
    return X.told(blocks, hits.unionByName(whole), last, schema)


def kept_words(batch_text, starts, ends) -> list[str]:
    """What is left of each text: words outside the spans, joined by one space."""
    out = []
    for text, a, b in zip(batch_text, starts, ends):
        data = text.encode()
        cuts = [0, *(x for pair in zip(a, b) for x in pair), len(data)]
        kept = b" ".join(data[i:j] for i, j in zip(cuts[::2], cuts[1::2]))
        out.append(b" ".join(kept.split()).decode())
    return out


def cut_texts(batch_text, starts, ends) -> list[str]:
    """Each text without the bytes of its spans; what stands between kept words stays as it is."""
    out = []
    for text, a, b in zip(batch_text, starts, ends):
        if not len(a):
            out.append(text)
            continue
        data = text.encode()
        cuts = [0, *(x for pair in zip(a, b) for x in pair), len(data)]
        out.append(b"".join(data[i:j] for i, j in zip(cuts[::2], cuts[1::2])).decode())
    return out


def without_repeats(docs: DataFrame, key: str = "doc_id", window: int = 35, extra=()) -> DataFrame:
    """``doc_id, text`` of each row with the repeated passages cut out, and its columns ``extra``; see ``repeated_spans``."""

    def cut(found: pa.Table) -> pa.Table:
        spans = (found.column(c).to_pylist() for c in ("text", "starts", "ends"))
        return pa.table({"doc_id": found.column("doc"), "text": pa.array(cut_texts(*spans), pa.string())} | {c: found.column(c) for c in extra})

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    return repeated_spans(docs, key, window=window, then=cut, schema="doc_id long, text string" + kinds, extra=extra)


def repeats_digest(docs: DataFrame, window: int = 35) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each document."""
    import hashlib

    def digest(found: pa.Table) -> pa.Table:
        n = found.column("n_words").to_numpy()
        kept = kept_words(*(found.column(c).to_pylist() for c in ("text", "starts", "ends")))
        left = np.array([x.count(" ") + 1 if x else 0 for x in kept], np.int64)
        return pa.table(
            {
                "doc_id": found.column("doc"),
                "n_words": pa.array(n, pa.int64()),
                "n_removed": pa.array(n - left, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept], pa.string()),
            }
        )

    return repeated_spans(docs, window=window, then=digest, schema="doc_id long, n_words long, n_removed long, kept_sha256 string")
