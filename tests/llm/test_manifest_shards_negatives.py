"""Manifest, shards and hard negatives against brute force on small, awkward tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import manifest, negatives, queries, ranks, shards
from docloom.session import written

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos int, `rank` int, size int, shard int"


def rows_of(n: int, langs=("en", "de", None, "é", "z")):
    rng = random.Random(5)
    out = []
    for i in range(n):
        text = rng.choice([None, "", "Ab c", "É X", "W " * 5000, f"text {i}"])
        out.append((rng.choice([i, i, i, None, 7]), text, "en" if i % 3 == 0 else rng.choice(langs), rng.choice(["a", "a", "", None, "b"]), rng.choice([None, i])))
    return out + [(7, "Same", "en", "a", 1)] * (n // 2)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, 3, 4) for r in rows], SCHEMA)


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text) -> str:
    doc_id, _, lang, source, n_chars = row
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def levels_over(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def manifest_by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), r))
    trees = {g: levels_over([x[2] for x in sorted(v, key=lambda x: x[:3])]) for g, v in groups.items()}
    names = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = levels_over([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for pos, (*_, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            digest, beside = leaf_of(r, r[1].translate(LOW)) if tampered else leaf, []
            for tree, i in ((trees[g], pos), (top, at)):
                for level in tree[:-1]:
                    run = level[i // 8 * 8 : i // 8 * 8 + 8]
                    digest = h(*run[: i % 8], digest, *run[i % 8 + 1 :])
                    beside += run[: i % 8] + run[i % 8 + 1 :]
                    i //= 8
            root = top[-1][0]
            out.append((r[0], leaf, trees[g][-1][0], root, h(*beside), digest, digest == root))
    return out


@pytest.mark.parametrize("n", [1, 9, 700])
def test_manifest(spark, n):
    rows = rows_of(n)
    got = Counter(tuple(r) for r in manifest.manifest_digest(frame(spark, rows)).collect())
    assert got == Counter(manifest_by_hand(rows))


def test_manifest_of_many_groups(spark, monkeypatch):
    """More groups than one run of tops, a lone row among them, and join keys of few rows."""
    monkeypatch.setattr(manifest, "MEET", 2)
    rows = [(i, "x", f"g{i % 70}" if i else "lone", "s", i) for i in range(600)]
    got = Counter(tuple(r) for r in manifest.manifest_digest(frame(spark, rows)).collect())
    assert got == Counter(manifest_by_hand(rows))


def test_manifest_empty(spark):
    assert manifest.manifest_digest(frame(spark, rows_of(9)).where("false")).count() == 0


def test_ranks(spark):
    rows = frame(spark, rows_of(300)).select("doc_id", ranks.group_text("source").alias("grp"))
    got = ranks.ranked(written(rows, "rows"), "grp", ["doc_id"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.grp, []).append((r["rank"], r.doc_id is not None, r.doc_id or 0, r["size"]))
    assert set(by) == {"-", "=", "=a", "=b"}
    for v in by.values():
        v.sort()
        assert [x[0] for x in v] == list(range(len(v))) and {x[3] for x in v} == {len(v)}
        assert [x[1:3] for x in v] == sorted(x[1:3] for x in v)


@pytest.mark.parametrize("n", [0, 3, 500])
def test_shards(spark, n):
    rows = rows_of(n)
    got = shards.shards_digest(frame(spark, rows)).collect() if n else shards.shards_digest(frame(spark, rows_of(3)).where("false")).collect()
    raw = [(r[0], r[3], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows]
    assert Counter((r.doc_id, r.source, r["size"], r.text_crc32) for r in got) == Counter(raw)
    counts = Counter(r.shard for r in got)
    each = [counts[s] for s in range(40)]
    assert sum(each) == len(rows) and max(each) - min(each) <= 1 and all(r.law == "rows" and r.grown_shard is None for r in got)
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(counts[s])) for s in range(40))
    for source in {r.source for r in got}:  # each shard has its share of each source
        share = Counter(r.shard for r in got if r.source == source)
        mean = sum(share.values()) / 40
        assert all(math.floor(mean) - 1 <= share[s] <= math.ceil(mean) + 1 for s in range(40))
    again = {(r.doc_id, r.text_crc32, r.source): (r.shard, r.slot) for r in got}
    places = Counter((r.doc_id, r.text_crc32, r.source) for r in got)
    for r in shards.shards_digest(frame(spark, random.Random(1).sample(rows, len(rows)) or rows_of(3)).repartition(3)).collect() if n else []:
        key = (r.doc_id, r.text_crc32, r.source)
        assert places[key] > 1 or again[key] == (r.shard, r.slot)


def test_written_shards(spark, tmp_path):
    rows = rows_of(200)
    docs = frame(spark, rows)
    back = shards.write_shards(docs, str(tmp_path / "shards"), 7).collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.leaf, r.shard) for r in back) == Counter((*r, "clash", 4) for r in rows)
    sizes = Counter(r["__shard"] for r in back)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["__slot"] for r in back if r["__shard"] == s) == list(range(n)) for s, n in sizes.items())


def negatives_by_hand(rows):
    good = []
    for k, v, label in rows:
        if k is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        good.append((k, q, (label + 1) % 10 if k % 7 == 0 else label))
    out = []
    for i, (k, q, label) in enumerate(good):
        if k % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w)), m, g, j) for j, (m, w, g) in enumerate(good) if j != i and len(w) == len(q))
        for p, m, *_ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
            out += [(k, m, r + 1, x[1], -p, -x[0]) for r, x in enumerate(fit)]
    return out


def vector_rows(n: int, scale: float = 1.0):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (scale * (centres[i % 6] + rng.normal(size=12) * 0.7)).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(100, rows[3][1], 2), (100, rows[3][1], 2), (None, rows[3][1], 2), (900, None, 1), (800, [None] * 12, 1), (700, [float("nan")] * 12, 1)]
    rows += [(600, [0.0] * 12, 1), (500, [1.0, 2.0], 1), (501, [1.0, 1.5], 1), (503, [0.5, 1.0], 2), (400, rows[0][1], None), (300, [], 1), (301, [], 2)]
    return rows + [(1000 + i, rows[9][1], i % 2) for i in range(60)]


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_negatives(spark, monkeypatch, scale):
    """Several blocks, groups and batches; repeated ids, ties, vectors of other lengths, sums beyond doubles."""
    for name, value in (("BLOCK", 64), ("GROUP", 3), ("BATCH", 2), ("DEPTH", 2)):
        monkeypatch.setattr(negatives, name, value)
    rows = vector_rows(310, scale)
    table = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, id string, pos int, block int")
    got = Counter(tuple(r) for r in negatives.negatives_digest(table).collect())
    want = Counter(negatives_by_hand(rows))
    assert got == want and len(want) > 20


def test_negatives_stop_early():
    """Where one row stands out, the lists are not read to their end."""
    rows = np.full((4000, 4), 1.0)
    rows[7] = 50
    lists, depths = negatives.Lists(rows), []
    seen = lists.seen
    lists.seen = lambda a, d: depths.append(d) or seen(a, d)
    a = np.ones((1, 4))
    found = negatives.searched(lists, a, np.ones((1, 4000), bool), np.full((1, 1), -np.inf), np.full((1, 1), np.inf), 1)
    assert [int(x[0]) for x in found] == [0, 0, 7, 200] and max(depths) == negatives.DEPTH


def test_negatives_empty(spark):
    table = spark.createDataFrame([(100, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert negatives.negatives_digest(table).count() == 0
    assert negatives.negatives_digest(table.where("false")).count() == 0


@pytest.mark.parametrize("name", ["op11_manifest", "op12_shards", "op13_hard_negatives"])
def test_new_queries_same_as_sql(spark, name):
    import compare

    sf = "/root/testdata/sf0.001"
    assert compare.differences(queries.QUERIES[name](spark, sf), compare.connection(sf), queries.SQL[name]) == []
