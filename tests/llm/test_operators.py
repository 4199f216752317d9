"""Corpus operators against brute force and libraries, on small and awkward inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import (
    chat, components, decontaminate, jaccard, language_model, pieces, quality, queries, repeats, token_files, vector_join, warc,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (0, f"Start here {PASSAGE} and end"), (1, f"other {PASSAGE} tail"), (2, ""), (3, None), (4, "one two"), (5, "One TWO"),
    (6, "x " * 90), (7, " \n "), (8, " ".join(f"v{i}" for i in range(300))), (9, " ".join(f"v{i}" for i in range(290))), (10, "É é\x85a b"),
    (11, "la " * 20000), (4, "one two"), (None, "no id"),
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return frame.withColumns({"block": F.lit("clash"), "doc": F.lit(1), "row_key": F.lit(2), "label": F.lit(3)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_repeats(docs, none):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.repeats_digest(docs).collect())
    words = [(k, WORD.findall(t or "")) for k, t in TEXTS]
    seen = Counter(tuple(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))
    want = Counter()
    for k, w in words:
        gone = {i + j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert got == want
    assert repeats.repeats_digest(none).count() == 0


def test_jaccard(docs, none):
    got = [(r.doc, r.n_shingles, r.component) for r in jaccard.jaccard_classes(docs).collect()]
    want = {0: (60, 0), 1: (58, 0), 2: (0, 2), 4: (1, 4), 5: (1, 4), 8: (296, 8), 9: (286, 8), 7: (0, 7), 6: (1, 6)}
    sizes = {k: v for k, *v in got}
    assert len(got) == len(TEXTS) and all(tuple(sizes[k]) == v for k, v in want.items())
    assert sizes[None][1] is None and jaccard.jaccard_classes(none).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (51, 50), (60, 60)], "a long, b long")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 51: 50}


def test_language_model(docs, none):
    rows = language_model.lm_scores(docs, F.col("doc_id") != 1).collect()
    counts = Counter(t for k, x in TEXTS if k != 1 for t in [*WORD.findall((x or "").translate(LOW)), None])
    n, v = sum(counts.values()), len(counts)
    assert all(r.train_tokens == n for r in rows) and len(rows) == len(TEXTS)
    text = dict(TEXTS)
    for r in rows:
        tokens = [*WORD.findall((text[r.doc] or "").translate(LOW)), None]
        base = sum(np.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(t in counts for t in tokens))
        assert r.base_score == pytest.approx(base) and r.score <= 0
    assert language_model.lm_scores(none, F.lit(True)).count() == 0


def test_decontamination(spark, docs, none):
    items = [(0, " ".join(f"W{i}" for i in range(5, 30))), (1, "two"), (2, None), (3, "..."), (None, "tail"), (4, "never seen")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination_digest(docs, bench).collect()}
    assert (got[0].n_words, got[0].n_hit, got[0].n_items) == (64, 25, 1)
    assert (got[1].n_hit, got[1].n_items) == (26, 1) and (got[4].n_hit, got[5].n_hit) == (1, 1)
    assert got[4].items_sha256 == hashlib.sha256(b"1").hexdigest() and not got[8].contaminated
    assert got[10].n_words == 3 and got[3].n_words == 0
    assert decontaminate.contamination_digest(none, bench).count() == 0
    assert not decontaminate.contamination_digest(docs, bench.where("false")).where("contaminated").count()


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "CELL", 20)
    monkeypatch.setattr(vector_join, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(size=16) * (0.12 if i % 3 else 0.5)).tolist(), i % 2) for i in range(90)]
    rows += [(200, rows[0][1], 0), (201, [0.0] * 16, 0), (202, None, 0), (203, [None] * 16, 0), (204, [float("nan")] * 16, 0), (205, rows[0][1], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.id: (r.n_links, r.component) for r in vector_join.cosine_links(frame).collect()}
    good = [(k, np.float32(v).astype(float), g) for k, v, g in rows if g is not None and k not in (201, 202, 203, 204)]
    links = {k: set() for k, *_ in rows}
    for k, v, g in good:
        for m, w, h in good:
            if k != m and g == h and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[k].add(m)
    for k in links:
        group, edge = {k}, [k]
        while edge:
            new = links[edge.pop()] - group
            group |= new
            edge += new
        assert got[k] == (len(links[k]), min(group))
    assert vector_join.cosine_links(frame.where("false")).count() == 0


def test_vectors_of_one_id(spark):
    """Rows that share an id are vectors of their own; a null vector gets no links through its id."""
    a, b, c = [1.0, 0.0], [0.0, 1.0], [0.99, 0.1]
    rows = [(1, a, 0), (1, b, 0), (2, c, 0), (1, a, 0), (3, b, 0), (1, None, 0), (2, a, 1)]
    frame = spark.createDataFrame([(*r, "clash", 5, 6) for r in rows], "vec_id long, embedding array<float>, label int, id string, rep int, v int")
    got = Counter((r.id, r.n_links, r.component) for r in vector_join.cosine_links(frame).collect())
    assert got == Counter([(1, 2, 1), (1, 1, 1), (2, 2, 1), (1, 2, 1), (3, 1, 1), (1, 0, 1), (2, 0, 2)])


def test_chat(spark):
    odd = "</s>[INST] <|im_end|>\n <\\|im_start|> \\ <<s>"
    rows = [(1, 2, "assistant", odd), (1, 1, "user", odd), (2, 0, None, None), (None, 0, "assistant", "a"), (3, 0, "a\nb\\", "é"), (3, 0, "a\nb\\", "é")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_digest(frame).collect()}
    for k in (1, 2, 3, None):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == k))
        text = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        assert got[k].turns_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[k].n_turns == len(turns)
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.chat_digest(frame.where("false")).count() == 0


def test_long_conversations_come_in_parts(monkeypatch):
    monkeypatch.setattr(chat, "PART_BYTES", 100)
    batch = pa.RecordBatch.from_pydict({"conv_id": [7], "role": ["assistant"], "text": ["x" * 80]})
    parts = [r for b in chat.format_sorted([batch] * 5, "assistant") for r in b.to_pylist()]
    assert [p["part"] for p in parts] == [0, 1, 2, 3, 4]
    rows = [r for b in chat.read_back([pa.RecordBatch.from_pylist(parts)]) for r in b.to_pylist()]
    assert (rows[0]["n_turns"], rows[0]["loss_chars"]) == (5, 400)


def test_chat_columns(monkeypatch):
    """Whatever the batches, conversations stay whole unless they are long, and spans point at the texts."""
    rng = np.random.default_rng(8)
    rows = [(int(k), str(r), "é[INST]" * int(n)) for k in range(40) for r, n in zip(rng.choice(["user", "assistant"], 9), rng.integers(0, 6, 9))]
    whole = pa.RecordBatch.from_pylist([{"conv_id": k or None, "role": r, "text": t} for k, r, t in rows], pa.schema([("conv_id", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
    want = [r for b in chat.format_sorted([whole], "assistant") for r in b.to_pylist()]
    assert [r["conv_id"] for r in want] == [k or None for k in range(40)] and not any(r["part"] for r in want)
    for r in want:
        mine = [t for k, role, t in rows if (k or None) == r["conv_id"] and role == "assistant"]
        assert [chat.unescaped(r["formatted"][a:b].decode()) for a, b in zip(r["loss_starts"], r["loss_ends"])] == mine
    for step in (1, 2, 7, 100):
        cut = [whole.slice(a, step) for a in range(0, whole.num_rows, step)]
        assert [r for b in chat.format_sorted(cut, "assistant") for r in b.to_pylist()] == want
    monkeypatch.setattr(chat, "PART_BYTES", 200)
    parts = [r for b in chat.format_sorted(cut, "assistant") for r in b.to_pylist()]
    assert len(parts) >= 40 and b"".join(r["formatted"] for r in parts) == b"".join(r["formatted"] for r in want)


def test_sentencepiece(docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t or "" for _, t in TEXTS] + ["  two  lead   ", "中文\U0001f600", "<s> a\0b \n\n", "a▁b", "aaaaaaa" * 9]
    ids, ends = pieces.shared_model(path).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [library.encode(t) for t in texts]
    rows = pieces.encoded(docs, path).collect()
    assert len(rows) == len(TEXTS) and all(r.exact and len(r.ids) == r.n_pieces for r in rows)
    assert pieces.encoded(none, path).count() == 0


def test_token_files(docs, none, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = token_files.Encoder(path, 2).tokenizer
    got = token_files.token_digest(docs, path).orderBy("start").collect()
    at = 0
    for r, (k, t) in zip(got, sorted(TEXTS, key=lambda x: (-1 if x[0] is None else x[0], x[1] or ""))):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (k, at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_files.token_digest(none, path).count() == 0


def test_added_tokens_have_their_own_ids(spark):
    from tokenizers import Tokenizer

    mark = "<|endoftext|>"
    texts = [f"end {mark} of text", mark, f"{mark}{mark}", f"a\n{mark}\n\nb", f"  {mark}  x", "<|endof", "text|>", f"é\u3000{mark} \u3000z", "plain", "x\n", "b\n\nc"]
    texts += [f"v{i}{'  ' if i % 2 else chr(10)}" for i in range(40)] + [f"v{i}\n\nw{i}" for i in range(40)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = token_files.token_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(got, texts, strict=True):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        at += len(ids)


def test_tokenizer_with_many_ids(spark, tmp_path):
    """Ids that two bytes do not hold, from a tokenizer with more entries; rules start above them."""
    import json

    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        made = json.load(f)
    made["model"]["vocab"] |= {f"unused{i}": 50_257 + i for i in range(20_000)}
    made["added_tokens"].append({**made["added_tokens"][0], "id": 70_257, "content": "<|far|>"})
    path = str(tmp_path / "many.json")
    with open(path, "w") as f:
        json.dump(made, f)
    texts = ["a <|far|> b", "<|far|>" * 50, "plain words", "", "x <|endoftext|> y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [[*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert max(map(max, want)) == 70_257
    got = token_files.token_digest(docs, path).orderBy("doc_id").collect()
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(ids, "<u4").tobytes()) for ids in want]
    block = token_files.Block(bytes(token_files.shards(docs, path).first().data))
    assert block.first == 70_258 and block.ids().tolist() == sum(want, [])


def test_grammar_blocks_are_read_from_anywhere():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 30, 20000).astype(np.uint32)
    ids[5000:9000] = 7
    block = token_files.Block(token_files.packed_block([1, None], np.array([15000, 5000]), ids, 50_257, 4, 8))
    assert len(block.symbols) < len(ids) and block.docs == [1, None]
    for a, b in ((0, None), (0, 1), (4999, 9001), (1024, 2048), (19999, 20000), (7, 7)):
        assert (block.ids(a, b) == ids[a:b]).all()


def pairs_seen_twice(symbols) -> int:
    """Pairs that two places hold, which do not overlap."""
    last, seen = {}, Counter()
    for i, pair in enumerate(zip(symbols[:-1], symbols[1:])):
        if i - last.get(pair, -2) > 1:
            seen[pair] += 1
            last[pair] = i
    return sum(n > 1 for n in seen.values())


def test_grammars_leave_no_repeated_pair(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rare = " ".join(f"rare{i} words" for i in range(300))
    texts = [f"{PASSAGE} copy"] * 3000 + [f"no {i} {rare}" for i in range(100)] + ["la " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blocks = [token_files.Block(bytes(r.data)) for r in token_files.shards(docs, path).collect()]
    n_ids, n_symbols = sum(b.size for b in blocks), sum(len(b.symbols) for b in blocks)
    assert n_ids > 400_000 and n_symbols < n_ids / 100
    assert not any(pairs_seen_twice(b.symbols.tolist()) for b in blocks)
    for block in blocks:
        whole = block.ids()
        assert len(whole) == block.size
        for a in range(0, block.size, 50_001):
            assert (block.ids(a, a + 777) == whole[a : a + 777]).all()


def test_grammar_needs_little_beside_its_block():
    """Passes over a block look at a part at a time; they held some 90 bytes an id."""
    import tracemalloc

    ids = np.random.default_rng(6).zipf(1.3, 1 << 21).astype(np.uint32) % 50_000
    tracemalloc.start()
    symbols, left, right, _ = token_files.compressed(ids, 50_257)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(symbols) < len(ids) and len(left) == len(right) > 1000
    assert peak < 65 * len(ids)


def test_encoder_forgets_what_is_not_met_again(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = token_files.Encoder(path, 2)
    monkeypatch.setattr(token_files.Encoder, "MOST", 300)
    asked = []
    monkeypatch.setattr(token_files.Encoder, "ids", lambda self, pieces, own=token_files.Encoder.ids: asked.extend(pieces) or own(self, pieces))
    common = " ".join(f"common{i}" for i in range(100))
    texts = [f"{common} " + " ".join(f"rare{k}x{i}" for i in range(90)) for k in range(12)] + [" ".join(f"many{i}" for i in range(400)), common]
    for t in texts:
        ids, n = encoder(pa.array([t, None]))
        want = encoder.tokenizer.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == [*want, 2, 2] and n.tolist() == [len(want) + 1, 1]
    assert Counter(asked)[b" common7"] == 2  # again only after a batch that fills the memory alone
    assert len(encoder.known) < 500


def test_token_files_move_texts_in_small_batches(spark, docs):
    from docloom.llm.arrays import ARROW_BYTES, ARROW_SETTING

    had = spark.conf.get(ARROW_SETTING, None)
    spark.conf.unset(ARROW_SETTING)
    token_files.shards(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert spark.conf.get(ARROW_SETTING) == str(ARROW_BYTES)
    if had is not None:
        spark.conf.set(ARROW_SETTING, had)


def test_quality(spark, docs, none):
    good = [(i, " ".join(f"word{(i * 7 + j) % 97}" for j in range(40)) + ".", 1) for i in range(100, 160)]
    bad = [(i, "BUY!! $$$ " * (i % 9 + 2), 0) for i in range(200, 260)]
    frame = spark.createDataFrame([r[:2] for r in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in good + bad], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality.quality_scores(frame, labels, F.col("doc_id") % 3 != 0).collect()}
    assert all((scores[k] >= 0.7) == bool(q) for k, _, q in good + bad)
    rows = quality.quality_scores(docs, labels, F.lit(True)).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_scores(none, labels, F.lit(True)).count() == 0


def test_calibration_rises():
    score, n = np.arange(5.0), np.array([1.0, 1000, 1000, 1000, 1])
    good = np.array([0.0, 1, 500, 999, 1])
    knots, shares = quality.isotonic(score, good, n)
    assert (np.diff(shares) > 0).all() and (np.diff(knots) > 0).all() and 0 < shares[0] < 0.01 and 0.99 < shares[-1] < 1
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = rng.integers(1, 30, 12).astype(float)
        knots, shares = quality.isotonic(rng.permutation(12).astype(float), np.floor(rng.random(12) * (n + 1)), n)
        assert (np.diff(shares) > 0).all() and (np.diff(knots) > 0).all()


def test_quality_learns_a_key_once(spark):
    """A repeated id with repeated labels weighs as much as any other."""
    rows = [(i, "calm words in a row, told well." if i % 2 else "$$$ BUY !!! $$$") for i in range(60)]
    marks = [(i, i % 2) for i in range(60)]
    plain = quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int"), F.lit(True))
    want = {r.doc_id: r.score for r in plain.collect()}
    rows, marks = rows + [rows[3]] * 500, marks + [marks[3]] * 40
    again = quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int"), F.lit(True))
    got = again.collect()
    assert len(got) == 560 and all(r.score == pytest.approx(want[r.doc_id]) for r in got)


def test_warc():
    page = '<html><head><title>T &amp; t</title><script>var a="</p>"</script></head><body><p>One<b>two</b></p><a href="/x?a=1&amp;b">l</a></body></html>'
    source = warc.response("http://a.org/é", page, "1")
    made = warc.derived(source)
    headers, _ = warc.parsed(source)
    for name in ("metadata", "conversion"):
        own, block = warc.parsed(made[name])
        assert own["WARC-Refers-To"] == headers["WARC-Record-ID"] and own["WARC-Target-URI"] == "http://a.org/é"
        assert own["WARC-Block-Digest"] == warc.sha1(block) and own["WARC-Date"] == headers["WARC-Date"]
    assert warc.parsed(made["conversion"])[1].decode() == "T & t\nOnetwo\nl"
    assert "outlink: /x?a=1&b\r\n" in warc.parsed(made["metadata"])[1].decode() and warc.derived(source) == made


OLD_HIDDEN = re.compile(r"<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
OLD_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def test_warc_scan_against_patterns(spark):
    """On pages whose hidden parts end, the scans find what plain patterns find."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    pages += ["<a href=x>1</a><A class='b' href = 'y>z'>2<a>3<a name=href href=\"\">", "a<b c<d", "<!-- x --><p>y<style>z</style >w", "<a <a href=q>", ""]
    for page in pages:
        assert warc.shown(page) == OLD_HIDDEN.sub(" ", page)
        assert warc.page_links(page) == [a or b or c for a, b, c in OLD_LINK.findall(page)]


def test_warc_hostile_pages():
    import time

    begun, n = time.process_time(), 300_000
    for piece in ("<!--", "<script>", "<title>", "<title", "<a ", "<a href", "<p", "<", "<a href= ", "<style></script>"):
        warc.derived(warc.response("u", piece * n, "1"))
    assert time.process_time() - begun < 60
    assert warc.plain_text("a<script>var x = 1") == "a" and warc.plain_text("a<!-- b") == "a"


def test_warc_encodings_and_bad_records(spark):
    import gzip

    def made(http: bytes, body: bytes) -> bytes:
        return warc.record({"warc-type": "response", "warc-record-id": "<urn:x>", "WARC-Target-URI": "u"}, b"HTTP/1.1 200 OK\r\n" + http + b"\r\n\r\n" + body)

    def text(data: bytes) -> str:
        return warc.parsed(warc.derived(data)["conversion"])[1].decode()

    assert text(made(b"transfer-encoding: chunked", b"5\r\n<p>he\r\n3;x=1\r\nllo\r\n0\r\n\r\n")) == "hello"
    assert text(made(b"Content-Encoding: gzip", gzip.compress(b"<p>packed"))) == "packed"
    assert text(made(b"Content-Encoding: gzip", b"<p>not packed")) == "not packed"
    bad = [(1, b"no record"), (2, b"WARC/1.1\r\nContent-Length: x\r\n\r\nabc"), (3, b""), (4, None), (5, made(b"", b"<p>fine"))]
    got = {r.page_id: r.error for r in warc.derivatives(spark.createDataFrame(bad, "page_id long, warc binary")).collect()}
    assert set(got) == {1, 2, 3, 5} and got[5] is None and all(got[k] for k in (1, 2, 3))


def test_warc_rows(spark):
    frame = spark.createDataFrame([(1, "u", "<p>a</p>"), (None, None, None), (2, "u", "")], "page_id long, url string, html string")
    rows = warc.warc_digest(frame).collect()
    assert len(rows) == 3 and all(r.linked and r.intact for r in rows)
    assert warc.warc_digest(frame.where("false")).count() == 0


def test_same_as_sql(spark):
    import compare

    sf = "/root/testdata/sf0.001"
    duck = compare.connection(sf)
    for name, sql in queries.SQL.items():
        assert compare.differences(queries.QUERIES[name](spark, sf), duck, sql) == [], name


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.run(spark, sf)
    assert 0 < kept.count() < docs.count() and kept.where("not exact").count() == 0
    assert kept.select("doc_id").distinct().count() == kept.count()


def test_jaccard_links_every_text_of_a_key(spark):
    one, two, odd = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, one), (1, two), (2, f"{one} more"), (3, f"{two} more"), (4, odd), (3, "alone here"), (None, one), (5, None)]
    got = Counter((r.doc, r.component) for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (4, 4), (None, None), (5, 5)])


def shingled(text):
    words = WORD.findall((text or "").translate(LOW))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_take_each_row_as_a_document(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    some = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    near = [" ".join(f"{x}{i}" for i in range(80)) for x in "abc"]
    texts = [*some, *near, *(f"{t} more" for t in near), near[0], near[0], "", "", " ", None, f"one {PASSAGE} two", f"three {PASSAGE} four"]
    rows = [([None, 7, 7, i][i % 4], t, "en", f"s{i % 2}") for i, t in enumerate(texts)]
    rows += [rows[2], rows[0], rows[60], rows[60], (None, None, None, None), (7, near[1], None, "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")

    def kept(stage):
        return Counter(tuple(r)[:4] for r in stage(spark, docs, sf).select("doc_id", "text", "lang", "source").collect())

    labels = queries.table(spark, sf, "labels")
    scored = quality.quality_scores(docs, labels, queries.remainder(4) != 2, carry=("text",)).collect()
    score = {r.text: r.score for r in scored}
    assert len(scored) == len(rows) and kept(p.keep_good) == Counter(r for r in rows if score[r[1]] >= 0.7)

    sets, group = [shingled(t) for _, t, *_ in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    got = kept(p.keep_one_of_each)
    assert sum(got.values()) == len(set(group)) and not got - Counter(rows)
    least = Counter(min((rows[k][0] for k in range(len(rows)) if group[k] == g), key=lambda x: (x is None, x or 0)) for g in set(group))
    assert Counter(k[0] for k in got.elements()) == least

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(rows, words):
        gone = {i + j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(35)}
        if len(gone) < len(w):
            want[r[0], " ".join(x for i, x in enumerate(w) if i not in gone), *r[2:]] += 1
    made = Counter()
    for (a, b, c, d), n in kept(p.cut_repeats).items():
        made[a, " ".join(WORD.findall(b)), c, d] += n
    assert made == want

    bench = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOW)) for r in queries.table(spark, sf, "benchmark").collect()]
    grams = {tuple(w[i : i + min(len(w), 10)]) for w in bench if w for i in range(len(w) - min(len(w), 10) + 1)}

    def clean(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        return not any(tuple(w[i : i + m]) in grams for m in {len(g) for g in grams} for i in range(len(w) - m + 1))

    assert kept(p.cut_benchmark) == Counter(r for r in rows if clean(r[1]))
