"""Scores of texts under a weighted backoff automaton that is learnt from the same corpus.

Every word is a state that remembers it as history, besides the start state and the root without
history. A state has an arc for each word seen after it in training, weighted with the smoothed
log-probability, and one failure arc to the root, weighted with what smoothing has kept back. The
root has an arc for each word, unseen ones included. Reading a word always leads to the word's own
state, so one pass from left to right scores a text.

Smoothing is a Dirichlet prior on the base distribution, which adds 0.1 to each count:
``P(w | h) = (c(h w) + prior * P(w)) / (c(h) + prior)``; it sums to one over all words for every h.
Counts cover all training texts. Each block of documents gets the arcs that it can take, never the
whole automaton.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .arrays import Words, from_planes, mixed, planes

END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949C7DEFE1D2E5B)
SCORES = "doc long, train boolean, n_tokens long, n_known long, base_score double, score double"
ADDED = 0.1


class Tokens:
    """Words of all texts with an end after each: hashes, what stands before, and the text of each."""

    def __init__(self, texts):
        words = Words(texts, lower=True)
        n = len(words.offsets) - 1
        self.first = words.first + np.arange(n + 1)
        size = len(words) + n
        self.hashes = np.full(size, END)
        inner = np.ones(size, bool)
        inner[self.first[1:] - 1] = False
        self.hashes[inner] = words.hashes[0]
        self.before = np.r_[START, self.hashes[:-1]][:size]
        self.before[self.first[:-1]] = START
        self.of = np.repeat(np.arange(n), np.diff(self.first))

    @property
    def pairs(self) -> np.ndarray:
        return mixed(self.before * np.uint64(0x9FB21C651E98DF25) ^ self.hashes) ^ self.hashes


def counted_keys(keys: np.ndarray, train: np.ndarray):
    """Distinct keys, their training counts, and the way back."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse[train], minlength=len(distinct)), inverse


def packed(distinct: np.ndarray, counts: np.ndarray, buckets: int, width: int):
    """Questions: the low ``width`` bytes of the keys of each bucket, sorted, and their counts."""
    mask = np.uint64((1 << 8 * width) - 1)
    for bucket, a, b in X.split(distinct, buckets):
        low = distinct[a:b] & mask
        order = np.argsort(low, kind="stable")
        steps = np.diff(low[order], prepend=np.uint64(0))
        yield bucket, X.counted(b - a) + planes(steps, width) + planes(counts[a:b][order].astype(np.uint64), 6)


def unpacked(asked: pa.Table, width: int):
    for q in asked.column("question"):
        data = q.as_py()
        n = X.count_of(data)
        low = np.cumsum(from_planes(data, width, 4, n), dtype=np.uint64)
        yield low, from_planes(data, 6, 4 + width * n, n).astype(np.int64)


def summed(asked: pa.Table, width: int):
    """Distinct keys of a bucket, their counts over all blocks, and each question's places among them."""
    parsed = list(unpacked(asked, width))
    distinct, inverse = np.unique(np.concatenate([low for low, _ in parsed]), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, inverse, np.concatenate([n for _, n in parsed]))
    return distinct, total, np.split(inverse, np.cumsum([len(low) for low, _ in parsed])[:-1])


class Model:
    #: Bytes kept of a word's and of a word pair's hash within its bucket.
    WORD, PAIR = 8, 5

    def __init__(self, buckets: int, prior: float):
        self.buckets, self.prior = buckets, prior

    def corpus_counts(self, batches):
        """Packed training counts of the words of some texts at a time."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                tokens = Tokens(rows.column("text"))
                train = rows.column("train").to_numpy(zero_copy_only=False).astype(bool)
                distinct, counts, _ = counted_keys(tokens.hashes[train[tokens.of]], slice(None))
                parts = list(packed(distinct, counts, self.buckets, self.WORD))
                yield X.questions(0, parts).to_batches()[0] if parts else pa.RecordBatch.from_pylist([], X.questions(0, []).schema)

    def bucket_totals(self, asked: pa.Table) -> pa.Table:
        _, total, _ = summed(asked, self.WORD)
        return pa.table({"types": [int((total > 0).sum())], "tokens": [int(total.sum())]})

    def ask(self, rows: pa.Table) -> pa.Table:
        """Words go to buckets from 0 up, word pairs to buckets from -1 down."""
        rows = X.ordered(rows)
        tokens = Tokens(rows.column("text"))
        train = rows.column("train").to_numpy()[tokens.of].astype(bool)
        distinct, counts, _ = counted_keys(tokens.hashes, train)
        parts = list(packed(distinct, counts, self.buckets, self.WORD))
        distinct, counts, _ = counted_keys(tokens.pairs, train)
        parts += [(-1 - b, q) for b, q in packed(distinct, counts, self.buckets, self.PAIR)]
        return X.questions(rows.column("block")[0].as_py(), parts)

    def answer(self, asked: pa.Table) -> pa.Table:
        width = self.WORD if asked.column("bucket")[0].as_py() >= 0 else self.PAIR
        _, total, places = summed(asked, width)
        return X.answers(asked, (planes(total[p].astype(np.uint64), 6) for p in places))

    def counts_of(self, distinct: np.ndarray, told: dict[int, bytes], width: int, name) -> np.ndarray:
        out, mask = np.zeros(len(distinct), np.int64), np.uint64((1 << 8 * width) - 1)
        for bucket, a, b in X.split(distinct, self.buckets):
            out[a + np.argsort(distinct[a:b] & mask, kind="stable")] = from_planes(told[name(bucket)], 6).astype(np.int64)
        return out

    def score(self, rows: pa.Table, told: pa.Table, types: int, total: int) -> pa.Table:
        if not rows.num_rows:
            rows = pa.table({"doc": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "row_key": pa.array([], pa.int64()), "train": pa.array([], pa.bool_())})
        rows, replies = X.ordered(rows), X.by_bucket(told)
        tokens = Tokens(rows.column("text"))
        words, inverse = np.unique(tokens.hashes, return_inverse=True)
        seen = self.counts_of(words, replies, self.WORD, lambda b: b)
        root = np.log10((seen + ADDED) / (total + ADDED * (types + 1)))  # arcs of the root
        ends = seen[np.searchsorted(words, END)] if rows.num_rows else 0
        history = np.r_[seen, ends]  # a start for each end
        failure = np.log10(self.prior / (history + self.prior))
        pairs, arc_of = np.unique(tokens.pairs, return_inverse=True)
        after = self.counts_of(pairs, replies, self.PAIR, lambda b: -1 - b)
        # the state before each word, carried from the word before; then its arc, or failure and root
        state = np.r_[len(words), inverse[:-1]][: len(inverse)] if len(inverse) else inverse
        state[tokens.first[:-1]] = len(words)
        n = after[arc_of]
        weight = failure[state] + root[inverse]
        arc = np.flatnonzero(n)
        weight[arc] = np.log10((n[arc] + self.prior * 10.0 ** root[inverse[arc]]) / (history[state[arc]] + self.prior))
        sums = lambda x: np.add.reduceat(x, tokens.first[:-1]) if rows.num_rows else x[:0]
        return pa.table(
            {
                "doc": rows.column("doc").cast(pa.int64()),
                "train": rows.column("train"),
                "n_tokens": pa.array(np.diff(tokens.first)),
                "n_known": pa.array(sums((seen[inverse] > 0).astype(np.int64))),
                "base_score": pa.array(sums(root[inverse])),
                "score": pa.array(sums(weight)),
            }
        )


def lm_scores(docs: DataFrame, train: F.col, key: str = "doc_id", text: str = "text", prior: float = 300.0) -> DataFrame:
    """``doc, train, n_tokens, n_known, base_score, score, train_tokens`` of every text.

    ``train`` is a boolean column expression that chooses the training texts (null: chosen). Words are
    lower-cased runs of non-space characters, followed by one end token. Null texts count as empty and
    have the end token only; rows with null or repeated keys are scored like all others; an empty table
    gives no rows. Without training texts every score comes from the base distribution alone. Other
    columns are not read.
    """
    flagged = docs.select(F.col(key), F.col(text), F.coalesce(train, F.lit(True)).alias("train"))
    blocks, _, size = X.text_blocks(flagged, key, text, extra=("train",))
    model = Model(max(1, size // 7 // X.BUCKET_HASHES), prior)
    count = blocks.select("text", "train").mapInArrow(lambda batches: model.corpus_counts(batches), X.ASKED)
    sums = count.groupBy("bucket").applyInArrow(lambda rows: model.bucket_totals(rows), "types long, tokens long")
    types, total = (x or 0 for x in sums.agg(F.sum("types"), F.sum("tokens")).first())
    replies = X.answer(X.ask(blocks, model.ask), model.answer)
    scored = X.told(blocks, replies, lambda rows, told: model.score(rows, told, types, total), SCORES)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
