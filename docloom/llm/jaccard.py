"""Similarity join of documents on word shingles: prefix filters under several global token orders.

Two sets whose Jaccard similarity reaches t share a token among the first
``n - ceil(t * n) + 1`` tokens of each set, whatever the order of all tokens is. The orders here are
(1) rare tokens first, (2) rare first with ties broken another way, (3) a pseudo-random order. A
pair is verified only when it shares a prefix token under all of them. Under the first order
the place of the first shared token bounds the overlap: no more than what follows in either set. Each token flips one of 256 bits of its set; two
sets differ in at least as many tokens as bits.

The result is a partition into components, so pairs inside one component need no check. Each round
pairs one document per (token, component) with the first of its token; when rounds merge nothing
any more, all pairs across components that pass the filters are verified. Groups of thousands
of near copies so cost one pair a member, and no link between components is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import exchange as X
from .arrays import Words, from_planes, mixed, planes, windows
from .components import components

SIGNATURES = (
    "doc long, n_shingles long, print_a long, print_b long, shared boolean, common long, "
    "bits0 long, bits1 long, bits2 long, bits3 long, "
    "prefix1 array<long>, prefix2 array<long>, prefix3 array<long>, tokens array<long>"
)
BITS = [f"bits{k}" for k in range(4)]
#: Tokens before a posting that it carries, so that a pair is formed at its first shared token only. A pair that shares none of
#: these but several later ones is formed once for each of those; it is made distinct before it is verified.
LEAD = 64


class ShingleSets:
    """The passes over a block: distinct shingles, then prefixes once their document counts are known."""

    def __init__(self, width: int, percent: int, buckets: int):
        self.width, self.percent, self.buckets = width, percent, buckets

    def sets(self, rows: pa.Table):
        """Distinct (text, shingle hash) pairs, sorted by text."""
        words = Words(rows.column("text"), lower=True)
        hashes, at = windows(words.hashes[0], words.first, self.width)
        of = words.text_of[at]
        counts = np.diff(words.first)
        short = np.flatnonzero((counts > 0) & (counts < self.width))
        if len(short):  # the whole text is the only shingle
            whole = np.empty(len(short), np.uint64)
            for n in np.unique(counts[short]):
                chosen = counts[short] == n
                h, a = windows(words.hashes[0], words.first, int(n), seed=100 + int(n))
                whole[chosen] = h[np.searchsorted(a, words.first[short[chosen]])]
            hashes, of = np.r_[hashes, whole], np.r_[of, short]
        order = np.lexsort((hashes, of))
        hashes, of = hashes[order], of[order]
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])] if len(of) else np.zeros(0, bool)
        return hashes[new], of[new]

    def ask(self, rows: pa.Table) -> pa.Table:
        distinct, counts = np.unique(self.sets(X.ordered(rows))[0], return_counts=True)
        parts = []
        for bucket, a, b in X.split(distinct, self.buckets):
            low = (distinct[a:b] >> np.uint64(8)) & np.uint64(0xFFFFFF)
            order = np.argsort(low, kind="stable")
            steps = np.diff(low[order], prepend=np.uint64(0))
            parts.append((bucket, X.counted(b - a) + planes(steps, 3) + planes(counts[a:b][order].astype(np.uint64), 4)))
        return X.questions(rows.column("block")[0].as_py(), parts)

    def answer(self, asked: pa.Table) -> pa.Table:
        total, parsed = np.zeros(1 << 24, np.uint32), []
        for q in asked.column("question"):
            data = q.as_py()
            n = X.count_of(data)
            low = np.cumsum(from_planes(data, 3, 4, n))
            np.add.at(total, low, from_planes(data, 4, 4 + 3 * n, n).astype(np.uint32))
            parsed.append(low)
        return X.answers(asked, (planes(total[low].astype(np.uint64), 4) for low in parsed))

    def signatures(self, rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            rows = pa.table({"doc": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "row_key": pa.array([], pa.int64())})
        rows = X.ordered(rows)
        hashes, of = self.sets(rows)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        spread, replies = np.zeros(len(distinct), np.int64), X.by_bucket(told)
        for bucket, a, b in X.split(distinct, self.buckets):
            order = np.argsort((distinct[a:b] >> np.uint64(8)) & np.uint64(0xFFFFFF), kind="stable")
            spread[a + order] = from_planes(replies[bucket], 4).astype(np.int64)
        spread = spread[inverse]
        n = np.bincount(of, minlength=rows.num_rows)
        first = np.r_[0, np.cumsum(n)]
        length = n - (self.percent * n + 99) // 100 + 1
        keys = hashes.view(np.int64)
        orders = [
            np.lexsort((hashes, spread, of)),
            np.lexsort((mixed(hashes ^ np.uint64(0x5DEECE66D1F3A7B9)), spread, of)),
            np.lexsort((mixed(hashes ^ np.uint64(0x2545F4914F6CDD1D)), of)),
        ]
        rank = np.arange(len(of)) - first[of]
        inside = rank < length[of]
        common = [o[inside & (spread[o] > 1)] for o in orders]
        shared = np.bincount(of[common[0]], minlength=rows.num_rows) > 0
        prefixes = [self.lists(keys[c], of[c], shared) for c in common]
        keep = shared[of]
        prints = [np.zeros(rows.num_rows, np.uint64) for _ in range(2)]
        for out, seed in zip(prints, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            if len(of):
                sums = np.r_[np.uint64(0), np.cumsum(mixed(hashes ^ np.uint64(seed)))]
                out[:] = sums[first[1:]] - sums[first[:-1]]
        bit = of * 256 + (mixed(hashes ^ np.uint64(0x27220A95FE1A2B17)) & np.uint64(255)).astype(np.int64)
        flips = np.bincount(bit, minlength=256 * rows.num_rows).astype(np.uint8) & 1
        bits = np.packbits(flips.reshape(-1, 256), axis=1).reshape(-1).view(np.int64).reshape(-1, 4)
        return pa.table(
            {
                "doc": rows.column("doc").cast(pa.int64()),
                "n_shingles": pa.array(n.astype(np.int64)),
                "print_a": pa.array(prints[0].view(np.int64)),
                "print_b": pa.array(prints[1].view(np.int64)),
                "shared": pa.array(shared),
                "common": pa.array(np.bincount(of[spread > 1], minlength=rows.num_rows).astype(np.int64)),
                **{f"bits{k}": pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)},
                "prefix1": prefixes[0],
                "prefix2": prefixes[1],
                "prefix3": prefixes[2],
                "tokens": self.lists(keys[keep], of[keep], shared),
            }
        )

    @staticmethod
    def lists(values: np.ndarray, of: np.ndarray, kept: np.ndarray) -> pa.Array:
        sizes = np.where(kept, np.bincount(of, minlength=len(kept)), 0)
        chosen = kept[of] if len(of) else np.zeros(0, bool)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values[chosen]))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets pass the other orders and then reach the similarity."""
    size = lambda side: F.col(f"{side}_n").cast("long")

    def side(name: str, columns):
        return sets.select(F.col("doc").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))

    light = ("n", "prefix2", "prefix3")
    near = pairs.join(side("a", light), "a").join(side("b", light), "b")
    near = near.where(
        (100 * F.least(size("a"), size("b")) >= percent * F.greatest(size("a"), size("b")))
        & F.arrays_overlap("a_prefix2", "b_prefix2")
        & F.arrays_overlap("a_prefix3", "b_prefix3")
    ).select("a", "b", "a_n", "b_n")
    full = near.join(side("a", ("tokens",)), "a").join(side("b", ("tokens",)), "b")
    shared = F.size(F.array_intersect("a_tokens", "b_tokens")).cast("long")
    return full.where(100 * shared >= percent * (size("a") + size("b") - shared)).select("a", "b")


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """``doc, n_shingles, component``: components of the links ``100 * |A & B| >= percent * |A | B|``.

    A set holds the distinct shingles of ``width`` lower-cased words; a shorter text is one shingle.
    Null, empty and wordless texts have an empty set and stay alone, as does a null key (component
    null). Rows that repeat a key are compared as one document each, and all end in the component of that
    key, which so holds what any of them is linked to. Equal sets are one class from the start. An empty table gives no rows; other
    columns are not read.
    """
    blocks, _, size = X.text_blocks(docs, key, text)
    maker = ShingleSets(width, percent, max(1, size // 7 // X.BUCKET_HASHES))
    counts = X.answer(X.ask(blocks, maker.ask), maker.answer)
    signs = written(X.told(blocks, counts, maker.signatures, SIGNATURES), "signatures")

    prints = ["n_shingles", "print_a", "print_b"]
    linkable = signs.where("shared and doc is not null")
    # a class is named by its prints, as one key can stand in several
    classes = linkable.groupBy(*prints).agg(F.min("doc").alias("doc")).withColumn("rep", F.xxhash64(*prints))
    classes = written(classes, "classes")
    sets = linkable.join(classes, [*prints, "doc"]).dropDuplicates(["rep"])
    sets = sets.drop("doc").withColumnRenamed("rep", "doc").withColumnRenamed("n_shingles", "n")
    sets = written(sets.select("doc", "n", "common", *BITS, "prefix1", "prefix2", "prefix3", "tokens"), "sets")
    posts = sets.select("doc", "n", "common", *BITS, F.posexplode("prefix1").alias("at", "token"))
    # tokens from this one on; those that no other document has come first in the order
    posts = posts.select("doc", "n", "common", *BITS, "token", (F.col("common") - F.col("at")).alias("rest"))
    several = posts.groupBy("token").agg(F.count("*").alias("docs")).where("docs > 1").select("token")
    posts = written(posts.join(several, "token"), "postings")

    links, tried = None, None
    place = posts.withColumn("component", F.col("doc"))
    while True:
        # one document of each component of a token, paired with the least of the token
        per = place.groupBy("token", "component").agg(F.min("doc").alias("b"))
        first = per.groupBy("token").agg(F.min_by("b", "component").alias("a"), F.count("*").alias("parts"))
        stars = per.join(first.where("parts > 1"), "token").where("a <> b")
        stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tried is not None:
            stars = stars.join(tried, ["a", "b"], "left_anti")
        stars = written(stars, "stars")
        found = written(verified(stars, sets, percent), "links")
        tried = stars if tried is None else tried.unionByName(stars)
        new = found.count()
        links = found if links is None else links.unionByName(found)
        if not new:
            break
        joined = components(links)
        known = posts.join(joined.withColumnRenamed("id", "doc"), "doc", "left")
        place = written(known.withColumn("component", F.coalesce("component", "doc")), "places")
    # whatever is left: all pairs across components that share a token
    parts = place.groupBy("token").agg(F.countDistinct("component").alias("parts")).where("parts > 1").select("token")
    # both prefixes follow one order, so a token that stands before this one in both is one where the pair forms already
    lead = F.slice("prefix1", F.lit(1), F.least(F.col("common") - F.col("rest"), F.lit(LEAD)).cast("int"))
    open_ = place.join(parts, "token").join(sets.select("doc", "prefix1"), "doc").withColumn("lead", lead)
    open_ = written(open_.select("token", "doc", "component", "n", "common", "rest", "lead", *BITS), "open")
    left, right = (
        open_.select("token", *(F.col(c).alias(f"{x}_{c}") for c in ("doc", "component", "n", "common", "rest", "lead", *BITS)))
        for x in "ab"
    )
    fits = (
        "a_component <> b_component and a_doc < b_doc"
        f" and 100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"
        f" and {100 + percent} * least(a_rest, b_rest) >= {percent} * (a_n + b_n)"
        f" and {100 + percent} * ({' + '.join(f'bit_count(a_{b} ^ b_{b})' for b in BITS)})"
        f" <= {100 - percent} * (a_n + b_n)"
        " and not arrays_overlap(a_lead, b_lead)"
    )
    rest = left.alias("a").join(right.alias("b"), (F.col("a.token") == F.col("b.token")) & F.expr(fits))
    rest = rest.select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b")).distinct()
    links = links.unionByName(verified(rest.join(tried, ["a", "b"], "left_anti"), sets, percent))

    named = signs.select("doc", *prints, F.when(F.col("shared") & F.col("doc").isNotNull(), True).alias("linkable"))
    # keys of several rows tie their classes, and rows that link to nothing
    keys = named.where("doc is not null").withColumn("rep", F.when(F.col("linkable"), F.xxhash64(*prints)))
    keys = keys.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("last"), (F.count("*") > F.count("rep")).alias("mixed"))
    keys = written(keys.where("a <> last or mixed and a is not null"), "keys")
    tied = named.where("linkable").select("doc", F.xxhash64(*prints).alias("b")).distinct()
    tied = tied.join(keys.where("a <> last").select("doc", "a"), "doc").select("a", "b").where("a <> b").distinct()
    joined = components(links.unionByName(tied)).withColumnRenamed("id", "rep")
    found = classes.join(joined, "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    least = found.groupBy("root").agg(F.min("doc").alias("component"))
    found = written(found.drop("component", "doc").join(least, "root").select("rep", *prints, "component"), "found")
    grouped = named.where("linkable").join(found.drop("rep"), prints).select("doc", "n_shingles", "component")
    known = keys.where("mixed").join(found.withColumnRenamed("rep", "a"), "a").select("doc", "component")
    alone = named.where("linkable is null").select("doc", "n_shingles").join(known, "doc", "left")
    return grouped.unionByName(alone.select("doc", "n_shingles", F.coalesce("component", "doc").alias("component")))
