"""Token ids of a corpus in grammar-compressed files.

Documents are dealt into shards by ranges of their ids and encoded in order. A shard is stored as
blocks, each by its own Re-Pair grammar: frequent pairs of neighbouring symbols are replaced by new
symbols, round after round, until no pair stands twice. A block keeps its rules, their expansion lengths, and the expanded place
of every 1024th symbol, so a range of ids is decoded without the rest of the block.

Block layout (little-endian): ``RPG2``, counts of documents, ids, rules, symbols and marks and the first rule's number (one
above all ids of the tokenizer) as 32-bit integers; document ids (64 bit) and a flag for null ids; ids per document; rules as two arrays of
symbols; expansion lengths; symbols and marks. Symbols are stored by byte planes, 3 bytes each.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_dir
from .arrays import SPACE, Spans, from_planes, gathered, give_back, in_small_batches, planes, text_bytes

MAGIC, MARK_EVERY = b"RPG2", 1024
#: Text bytes of a shard on average, text bytes encoded at once, and ids of a block.
SHARD_BYTES, BATCH_BYTES, BLOCK_IDS = 16 << 20, 4 << 20, 1 << 21
#: Places of a block that a pass looks at together, and ids read back together; it bounds what stands beside the block itself.
STEP = 1 << 18
#: Bytes that end neither ASCII white space nor a separator; those above ASCII are looked at further.
SOLID = ~SPACE
SOLID[0x1C:0x20] = False
BLOCKS = "shard int, block int, n_docs long, n_ids long, data binary"
READ = "shard int, block int, doc long, before long, n_tokens long, ids_crc32 long"


def chunk_borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts can be cut without changing how the tokenizer splits words.

    That is before ASCII white space behind anything that is not white space of any kind; the words it
    splits off never reach across such a place. Bytes that could end other white space are not cut behind.
    """
    n = len(data)
    at = np.flatnonzero(SPACE[data[1:]] & SOLID[data[:-1]]) + 1
    tail = np.flatnonzero(data[at - 1] >= 0x80)
    place = at[tail]
    one, two, three = (np.where(place >= k, data[np.maximum(place - k, 0)], 0) for k in (1, 2, 3))
    wide = (
        ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
        | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81)))
        | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
    )
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    cut[place[wide]] = False
    cut[offsets] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts; each distinct piece between safe borders is tokenized once while it is remembered.

    New pieces are tokenized as long texts: a piece that begins with white space can follow one that does
    not end with it, and the byte lengths of the ids tell where each ends. Added tokens such as
    ``<|endoftext|>`` are pieces of their own, as the tokenizer splits them off before anything else.
    """

    #: Pieces remembered at most, by 64-bit hash; then those not met again since they came, or since the last time, are forgotten.
    MOST = 1_200_000

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads cost memory
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), np.array([end_id], np.uint32)
        vocabulary, added = self.tokenizer.get_vocab(with_added_tokens=False), self.tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("added tokens that depend on the text around them are not built")
        self.size = np.zeros(max(*vocabulary.values(), *added, end_id) + 1, np.int64)
        if len(self.size) > 1 << 23:  # half of what 3 bytes name is left for rules
            raise ValueError("a tokenizer with so many ids is not built")
        self.kind = np.uint16 if len(self.size) <= 1 << 16 else np.uint32
        for piece, n in vocabulary.items():
            self.size[n] = len(piece)  # one letter for each byte
        for n, token in added.items():
            self.size[n] = len(token.content.encode())
        contents = sorted((t.content.encode() for t in added.values()), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, contents))) if contents else None
        self.apart = any(SPACE[list(c)].any() for c in contents)  # joined pieces could spell an added token
        self.forget()

    def forget(self) -> None:
        self.known, self.values, self.at = np.zeros(0, np.uint64), np.zeros(0, self.kind), np.zeros(1, np.int64)
        self.again, self.slots = np.zeros(0, bool), np.full(1 << 16, -1, np.int32)

    def forget_rare(self) -> None:
        """Keep the pieces that were met again."""
        kept = np.flatnonzero(self.again)
        known, (values, at) = self.known[kept], ragged(self.values, self.at, kept)
        self.forget()
        self.remember(known, values, at)

    def remember(self, hashes: np.ndarray, values: np.ndarray, at: np.ndarray) -> None:
        """Add pieces that are not known: their hashes, ids and offsets of ids."""
        had = len(self.known)
        self.known, self.values = np.r_[self.known, hashes], np.r_[self.values, values]
        self.at, self.again = np.r_[self.at, self.at[-1] + at[1:]], np.r_[self.again, np.zeros(len(hashes), bool)]
        if 2 * len(self.known) > len(self.slots):  # a table of slots, at most half full
            self.slots, had = np.full(1 << (2 * len(self.known)).bit_length(), -1, np.int32), 0
        hashes, last = self.known[had:], np.uint64(len(self.slots) - 1)
        slot, left = (hashes & last).astype(np.intp), np.arange(len(hashes))
        while len(left):  # a taken slot sends on to the next one
            free = self.slots[slot[left]] < 0
            tried = left[free]
            self.slots[slot[tried]] = had + tried
            left = np.r_[left[~free], tried[self.slots[slot[tried]] != had + tried]]
            slot[left] = slot[left] + 1 & int(last)

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of known pieces, -1 for others."""
        last = len(self.slots) - 1
        slot = (hashes & np.uint64(last)).astype(np.intp)
        out = self.slots[slot]
        left = np.flatnonzero(out >= 0)
        while len(left := left[self.known[out[left]] != hashes[left]]):
            slot[left] = slot[left] + 1 & last
            out[left] = self.slots[slot[left]]
            left = left[out[left] >= 0]
        return out

    def borders(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin: at safe borders, and around added tokens but not inside them."""
        border = chunk_borders(data, offsets)
        flat = data.tobytes()
        if self.added is None or self.added.search(flat) is None:
            return border
        found = [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for m in self.added.finditer(flat, a, b)]
        if not found:
            return border
        start, end = np.array(found).T
        last = np.searchsorted(start, border) - 1  # the last token that starts before the border
        return np.union1d(border[(last < 0) | (border >= end[last])], np.r_[start, end])

    @staticmethod
    def open_end(piece: bytes) -> bool:
        """Whether white space of any kind ends the piece, which more of it would change."""
        return piece[-1] <= 32 or piece[-1] >= 0x80 and piece[-4:].decode(errors="ignore")[-1:].isspace()

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and their offsets."""
        out, sizes = [], []
        for k in range(0, len(pieces), 4096):
            own = pieces[k : k + 4096]
            # has to begin a text
            joint = [i for i, p in enumerate(own) if p[0] > 32 or self.apart or i and not 32 < own[i - 1][-1] < 128 and self.open_end(own[i - 1])]
            cuts = sorted({0, *joint, len(own)})
            texts = [b"".join(own[a:b]).decode() for a, b in zip(cuts[:-1], cuts[1:])]
            made = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            found = np.fromiter(chain.from_iterable(made), self.kind)
            ends = np.cumsum(self.size[found])
            borders = np.cumsum([len(p) for p in own])
            last = np.searchsorted(ends, borders)
            if (ends[last] != borders).any():
                raise ValueError("a token crosses a border between words")
            out.append(found), sizes.append(np.diff(last, prepend=-1))
        return np.concatenate(out or [np.zeros(0, self.kind)]), np.r_[0, np.cumsum(np.concatenate(sizes))] if sizes else np.zeros(1, np.int64)

    def numbers(self, spans: Spans) -> np.ndarray:
        """Numbers of all pieces; new ones are tokenized and remembered."""
        hashes = spans.hashes[0]
        numbers = self.found(hashes)
        new = np.flatnonzero(numbers < 0)
        if not len(new):
            return numbers
        distinct, first = np.unique(hashes[new], return_index=True)
        if len(self.known) and len(self.known) + len(distinct) > self.MOST:
            self.again[numbers[numbers >= 0]] = True
            self.forget_rare()
            if len(self.known) + len(distinct) > self.MOST:
                self.forget()
            return self.numbers(spans)
        self.again[numbers[numbers >= 0]] = True
        first = new[first]
        flat = spans.data.tobytes()
        pieces = [flat[a:b] for a, b in zip(spans.start[first].tolist(), spans.end[first].tolist())]
        self.remember(distinct, *self.ids(pieces))
        numbers[new] = self.found(hashes[new])
        return numbers

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id behind each text, and the number of each text."""
        data, offsets = text_bytes(texts)
        border = self.borders(data, offsets)
        border = border[border < len(data)]
        spans = Spans(data, offsets, border, np.r_[border[1:], len(data)] if len(border) else border)
        numbers = self.numbers(spans)
        n = len(offsets) - 1
        chosen = np.full(len(numbers) + n, len(self.known), np.int32)
        inner = np.ones(len(chosen), bool)
        inner[spans.first[1:] + np.arange(n)] = False
        chosen[inner] = numbers
        out, ends = ragged(np.r_[self.values, self.end.astype(self.kind)], np.r_[self.at, len(self.values) + 1], chosen)
        return out.astype(np.uint32), np.diff(ends[np.r_[0, spans.first[1:] + np.arange(1, n + 1)]])


def ragged(values: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``gathered``, a part of the rows at a time."""
    new = np.r_[0, np.cumsum(np.diff(offsets)[chosen])]
    out = np.empty(new[-1], values.dtype)
    for k in range(0, len(chosen), STEP):
        out[new[k] : new[min(k + STEP, len(chosen))]] = gathered(values, offsets, chosen[k : k + STEP])[0]
    return out, new


@lru_cache(1)
def shared_encoder(path: str, end_id: int) -> Encoder:
    """One encoder for each worker process; what it remembers does not change results."""
    return Encoder(path, end_id)


def pairs(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The pairs of neighbours at some places, as one number each."""
    return symbols[at].astype(np.uint64) << np.uint64(32) | symbols[at + 1]


def places(symbols: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The places that count among ``at``, every other one in a run of one symbol; slots of their pairs in round ``k``, and the bits of a slot."""
    parts = [slice(i, i + STEP) for i in range(0, len(at), STEP)]
    same = np.concatenate([np.flatnonzero(symbols[at[p]] == symbols[at[p] + 1]) + p.start for p in parts])
    if len(same):
        place = at[same]
        begin = np.r_[True, np.diff(place) > 1]
        odd = (place - np.maximum.accumulate(np.where(begin, place, 0))) % 2 == 1
        kept = np.ones(len(at), bool)
        kept[same[odd]] = False
        at = at[kept]
    bits = min(20, max(10, (2 * len(at)).bit_length()))
    slots = np.empty(len(at), np.int32)
    for i in range(0, len(at), STEP):
        a, b = symbols[at[i : i + STEP]], symbols[at[i : i + STEP] + 1]
        slot = a * np.uint32((0x9E3779B1 + 0x3C6EF372 * k) & 0xFFFFFFFF | 1) ^ b * np.uint32((0x85EBCA6B + 0x27D4EB2E * k) & 0xFFFFFFFF | 1)
        slot ^= slot >> np.uint32(15)
        slots[i : i + STEP] = (slot * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)
    return at, slots, bits


def highest(spots: np.ndarray, held: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which places hold a pair more frequent than those that overlap it; the slot decides between equals."""
    taken = np.ones(len(spots), bool)
    for i in range(0, len(spots), STEP):
        part = slice(i, i + STEP + 1)  # one more, to look at the next part's first
        rank = counts[held[part]].astype(np.int64) << 20 | held[part]
        apart = np.diff(spots[part]) > 1
        taken[i + 1 : i + len(rank)] &= apart | (rank[:-1] < rank[1:])
        taken[i : i + len(rank) - 1] &= apart | (rank[:-1] > rank[1:])
    return taken


def compressed(ids: np.ndarray, first: int, rounds: int | None = None, least: int = 2):
    """Symbols and rules ``left, right, length`` after replacing pairs until none is seen ``least`` times.

    Rules are numbered from ``first``, which is above all ids. ``rounds`` ends it earlier. Of overlapping pairs the more frequent is replaced, of equally frequent
    ones the same in every copy; in a run of one symbol every other place counts. Pairs are counted in a
    table of hash slots, each for the pair that wrote to it last, so a round takes a few passes and no
    sort; a pair that another has driven out of its slot is left for the next round, whose slots differ.
    A pair seen too seldom can only become rarer, so its places rest until a neighbour is replaced.
    """
    symbols = ids.astype(np.uint32)
    left, right, length = [], [], []
    size = [np.ones(first, np.int64)]
    live = np.ones(max(0, len(symbols) - 1), bool)  # pairs that may be frequent
    k = 0
    while (rounds is None or k < rounds) and len(at := np.flatnonzero(live)):
        at, slots, bits = places(symbols, at.astype(np.int32), k)
        holder, parts = np.zeros(1 << bits, np.uint64), [slice(i, i + STEP) for i in range(0, len(at), STEP)]
        for part in parts:
            holder[slots[part]] = pairs(symbols, at[part])
        own = np.concatenate([holder[slots[part]] == pairs(symbols, at[part]) for part in parts])
        counts = np.zeros(1 << bits, np.int32)
        for part in parts:
            np.add.at(counts, slots[part][own[part]].astype(np.intp), np.int32(1))
        frequent = counts >= least  # a table of bytes stays in the cache
        often = np.concatenate([own[part] & frequent[slots[part]] for part in parts])
        live[at[own & ~often]] = False
        k += 1
        if not often.any():
            continue
        spots, held = at[often], slots[often]
        taken = highest(spots, held, counts)
        where, held = spots[taken], held[taken]
        del at, slots, own, often, spots, taken
        uses = np.bincount(held, minlength=1 << bits)
        enough = uses >= least
        several = enough[held]
        where, held = where[several], held[several]
        del several
        used = np.flatnonzero(enough)
        if first + len(used) > 1 << 24:  # no more rules than 3 bytes can name
            break
        rule = np.zeros(1 << bits, np.uint32)
        rule[used] = np.arange(first, first + len(used), dtype=np.uint32)
        first += len(used)
        left.append((holder[used] >> np.uint64(32)).astype(np.int64)), right.append((holder[used] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        known = np.concatenate(size)
        length.append(known[left[-1]] + known[right[-1]])
        size = [known, length[-1]]
        symbols[where] = rule[held]
        live[where] = live[np.minimum(where + 1, len(live) - 1)] = True
        live[np.maximum(where - 1, 0)] = True
        kept = np.ones(len(symbols), bool)
        kept[where + 1] = False
        # the pair behind a replaced one starts at the new symbol
        live = live[kept[: len(live)]][: int(kept.sum()) - 1]
        symbols = symbols[kept]
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, length)]
    return symbols, *joined


def packed_block(docs, counts: np.ndarray, ids: np.ndarray, first: int, rounds: int | None = None, least: int = 2) -> bytes:
    symbols, left, right, length = compressed(ids, first, rounds, least)
    width = np.r_[np.ones(first, np.int64), length][symbols]
    marks = np.r_[0, np.cumsum(width)][:-1:MARK_EVERY]
    known = np.array([d is not None for d in docs], np.uint8)
    head = np.array([len(docs), len(ids), len(left), len(symbols), len(marks), first], "<u4").tobytes()
    parts = [np.array([d or 0 for d in docs], "<i8").tobytes(), known.tobytes(), counts.astype("<u4").tobytes()]
    parts += [planes(x.astype(np.uint64), 3) for x in (left, right)]
    return b"".join([MAGIC, head, *parts, length.astype("<u4").tobytes(), planes(symbols.astype(np.uint64), 3), marks.astype("<u4").tobytes()])


class Block:
    """A stored block: document ids and sizes, and the ids of any range."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token block")
        docs, self.size, rules, symbols, marks, self.first = (int(x) for x in np.frombuffer(data, "<u4", 6, 4))
        at = 28
        ids = np.frombuffer(data, "<i8", docs, at)
        known = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.docs = [int(d) if k else None for d, k in zip(ids, known)]
        at += 9 * docs
        self.counts = np.frombuffer(data, "<u4", docs, at).astype(np.int64)
        at += 4 * docs
        self.left = np.r_[np.zeros(self.first, np.int64), from_planes(data, 3, at, rules).astype(np.int64)]
        self.right = np.r_[np.zeros(self.first, np.int64), from_planes(data, 3, at + 3 * rules, rules).astype(np.int64)]
        at += 6 * rules
        self.length = np.r_[np.ones(self.first, np.int64), np.frombuffer(data, "<u4", rules, at).astype(np.int64)]
        at += 4 * rules
        self.symbols = from_planes(data, 3, at, symbols).astype(np.int64)
        self.marks = np.frombuffer(data, "<u4", marks, at + 3 * symbols).astype(np.int64)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from ``start`` to before ``stop``; only the symbols around them are expanded."""
        stop = self.size if stop is None else min(stop, self.size)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = int(np.searchsorted(self.marks, start, "right")) - 1, int(np.searchsorted(self.marks, stop, "left"))
        symbols = self.symbols[a * MARK_EVERY : b * MARK_EVERY]
        at = int(self.marks[a]) + np.r_[0, np.cumsum(self.length[symbols])][:-1]
        out = np.empty(stop - start, np.uint32)
        while len(symbols):
            inside = (at < stop) & (at + self.length[symbols] > start)
            symbols, at = symbols[inside], at[inside]
            single = symbols < self.first
            out[at[single] - start] = symbols[single]
            symbols, at = symbols[~single], at[~single]
            halves = self.left[symbols], self.right[symbols]
            symbols, at = np.concatenate(halves), np.r_[at, at + self.length[halves[0]]]
        return out


def shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 2, rounds: int | None = None, least: int = 2) -> DataFrame:
    """Blocks ``shard, block, n_docs, n_ids, data`` of all rows in ascending order of ``key``.

    Null keys come first; rows with equal keys follow each other by text. Null texts count as empty and
    give the end id alone; an empty table gives no blocks; other columns are not read.
    """
    rows = in_small_batches(docs).select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def write(batches):
        from pyspark import TaskContext

        encoder, shard, block = shared_encoder(path, end_id), TaskContext.get().partitionId(), 0
        held, docs_held, counts = [], [], []

        def flush():
            ids, n = np.concatenate(held), np.concatenate(counts)
            row = {"shard": [shard], "block": [block], "n_docs": [len(docs_held)], "n_ids": [len(ids)], "data": [packed_block(docs_held, n, ids, len(encoder.size), rounds, least)]}
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds)], list(row))

        for whole in batches:
            sizes = np.cumsum(pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False))
            at = 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, "right")))
                batch = whole.slice(at, to - at)
                ids, n = encoder(batch.column("text"))
                held.append(ids.astype(np.uint32)), counts.append(n)
                docs_held += batch.column("doc").to_pylist()
                at = to
                if sum(map(len, held)) >= BLOCK_IDS:
                    yield flush()
                    held, docs_held, counts, block = [], [], [], block + 1
                    give_back()
        if held:
            yield flush()
        held.clear()
        give_back()

    dealt = rows.repartitionByRange(max(1, -(-size // SHARD_BYTES)), "doc").sortWithinPartitions("doc", "text")
    return dealt.mapInArrow(write, BLOCKS)


def read_documents(blocks: DataFrame) -> DataFrame:
    """``doc, start, n_tokens, ids_crc32`` of each stored document; ``start`` counts the ids of all documents before."""

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(batch.column("data")[k].as_py())
                raw = np.empty(block.size, "<u4")
                for a in range(0, block.size, STEP):
                    raw[a : a + STEP] = block.ids(a, a + STEP)
                ends = np.cumsum(block.counts)
                crc = [zlib.crc32(raw[e - n : e].tobytes()) for e, n in zip(ends, block.counts)]
                where = {c: pa.array([batch.column(c)[k].as_py()] * len(crc), pa.int32()) for c in ("shard", "block")}
                yield pa.RecordBatch.from_pydict(
                    where | {"doc": pa.array(block.docs, pa.int64()), "before": pa.array(ends - block.counts),
                             "n_tokens": pa.array(block.counts), "ids_crc32": pa.array(crc, pa.int64())}
                )
                del block, raw
                give_back()

    sizes = blocks.select("shard", "block", "n_ids")
    in_shard = sizes.withColumn("base", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids"))
    totals = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one short row a shard
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_base"))
    bases = in_shard.join(before, "shard").select("shard", "block", (F.col("base") + F.col("shard_base")).alias("base"))
    found = blocks.select("shard", "block", "data").mapInArrow(read, READ)
    return found.join(bases, ["shard", "block"]).select("doc", (F.col("before") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, path: str) -> DataFrame:
    spark = docs.sparkSession
    folder = fresh_dir(spark, "tokens")
    shards(docs, path).write.option("compression", "zstd").parquet(folder)
    found = read_documents(spark.read.schema(BLOCKS).parquet(folder))
    return found.select(F.col("doc").alias("doc_id"), "start", "n_tokens", "ids_crc32")
