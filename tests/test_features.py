"""Search, steps, dates, summaries and rules on small, awkward inputs."""

import datetime as dt
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.functions import dates, predicates as Q, summaries
from docloom.operators import articles, chain as P, nearest as K, rules, textindex, wordspace
from docloom.session import written
from docloom.store import DocumentStore
from docloom.streaming import ingest


@pytest.mark.parametrize("clause", [None, Q.term("tag", "a")])
def test_nearest_for_many(spark, monkeypatch, clause):
    """Many cells, a cell in several parts, equal vectors, repeated keys, unusable rows and queries, fewer rows than k."""
    monkeypatch.setattr(K, "CELL", 30)
    monkeypatch.setattr(K, "BLOCK", 25)
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=5).round(1).tolist(), "ab"[i % 2]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 5, "ab"[i % 2]) for i in range(150)] + [(7, [9.0] * 5, "a"), (7, [9.1] * 5, "a")]
    rows += [(2000, None, "a"), (2001, [], "a"), (2002, [None] * 5, "a"), (2003, [math.nan] * 5, "a")]
    asked = [(i, rng.normal(size=5).tolist()) for i in range(60)] + [(90, [0.5] * 5), (91, [9.0] * 5), (92, None), (93, [math.inf] * 5), (5, [0.0] * 5)]
    frame = spark.createDataFrame(rows, "k long, v array<double>, tag string")
    queries = spark.createDataFrame(asked, "q long, w array<double>").repartition(4)
    got = K.nearest_many(frame, "v", "k", queries, "q", "w", 12, clause, ["tag"]).collect()
    usable = [(k, np.array(v), t) for k, v, t in rows if v and None not in v and all(map(math.isfinite, v)) and (clause is None or t == "a")]
    want = Counter()
    for q, w in asked:
        if not w or not all(map(math.isfinite, w)):
            continue
        near = sorted((float(((v - np.array(w)) ** 2).sum()), k, t) for k, v, t in usable)[:12]
        want.update((q, r + 1, k, t, round(math.sqrt(d), 9)) for r, (d, k, t) in enumerate(near))
    assert Counter((r.q, r["rank"], r.k, r.tag, round(r.distance, 9)) for r in got) == want
    assert K.nearest_many(frame.where("false"), "v", "k", queries, "q", "w", 3).count() == 0
    few = K.nearest_many(frame.limit(2), "v", "k", queries.limit(1), "q", "w", 3)
    assert few.count() == 2


def test_knn_clause_with_ties(spark):
    frame = spark.createDataFrame([(i, [float(i % 3)], i) for i in range(9)] + [(9, None, 9)], "k int, v array<double>, n int")
    near = K.knn("v", [0.0], 2, key="k")
    assert {r.k for r in frame.where(near(frame)).collect()} == {0, 3}
    both = Q.bool_query([near, Q.term("n", 3)])
    assert {r.k for r in frame.where(both(frame)).collect()} == {3}
    assert {r.k for r in frame.where(Q.must_not(near)(frame)).collect()} == {1, 2, 4, 5, 6, 7, 8, 9}
    none = K.knn("v", [0.0], 2, key="k", among=Q.term("n", 77))
    assert frame.where(none(frame)).count() == 0


def test_words_by_context(spark):
    docs = [["a", "b", "a"], ["b"], [], ["c", "a", "d", "b", "a", "a"], ["x", "y"]] * 3
    pairs = Counter()
    for w in docs:
        for i in range(len(w)):
            for j in range(len(w)):
                if i != j and abs(i - j) <= 2:
                    pairs[w[i], w[j]] += 1
    frame = spark.createDataFrame([(w,) for w in docs], "w array<string>")
    counts = written(wordspace.neighbour_counts(frame, "w", window=2), "counts")
    assert {(r.word, r.context): r.n for r in counts.collect()} == pairs
    total, own = sum(pairs.values()), Counter()
    for (a, _), n in pairs.items():
        own[a] += n
    weight = {p: math.log2(n * total / (own[p[0]] * own[p[1]])) for p, n in pairs.items()}
    weight = {p: x for p, x in weight.items() if x > 0}
    row = lambda a: np.array([weight.get((a, c), 0.0) for c in "abcdxy"])
    weights = written(wordspace.context_weights(counts), "weights")
    got = wordspace.nearest_words(weights, spark.createDataFrame([("a",), ("c",), ("nowhere",)], "word string"), 2).collect()
    want = {}
    for a in "ac":
        cos = {b: round(float(row(a) @ row(b) / np.linalg.norm(row(a)) / np.linalg.norm(row(b))), 6) for b in "abcdxy" if b != a and row(a) @ row(b) > 0}
        want[a] = sorted(cos.items(), key=lambda x: (-x[1], x[0]))[:2]
    found = {a: [(r.word, pytest.approx(r.cosine, abs=2e-6)) for r in sorted(got, key=lambda r: r["rank"]) if r.asked == a] for a in "ac"}
    assert found == want and len(got) == sum(map(len, want.values()))


def test_text_index(spark):
    docs = [(1, ["red", "fox", "red"]), (2, ["blue", "fox"]), (3, []), (4, ["fox"]), (5, ["red", "fox", "red"])]
    index = textindex.TextIndex(spark.createDataFrame(docs, "k int, w array<string>"), "k", "w")
    asked = spark.createDataFrame([(1, ["red", "red"]), (2, ["unknown"]), (3, [])], "q int, w array<string>")
    got = index.search(asked, "q", "w", 5).orderBy("rank").collect()
    assert [(r.q, r["rank"], r.k) for r in got] == [(1, 1, 1), (1, 2, 5)]
    red, fox = math.log(6 / 3), math.log(6 / 5)
    assert got[0].score == pytest.approx(2 * red / math.hypot(2 * red, fox), abs=1e-6)


def test_text_index_moves_no_postings(spark, monkeypatch):
    """The rows of all words of all documents stay in the parts of their documents while the index is made."""
    monkeypatch.setattr(textindex, "lookup_join", None)
    docs = [(i, [f"w{i % 7}", f"w{i % 5}", "all"]) for i in range(100)]
    index = textindex.TextIndex(spark.createDataFrame(docs, "k int, w array<string>").repartition(4), "k", "w")
    assert index.postings.where("word = 'all'").count() == 100 and index.words.where("word = 'all'").first().idf == 0


def test_text_index_of_repeated_keys(spark):
    """Rows that share a key are one document; a null key is none."""
    docs = [(1, ["red", "fox"]), (1, ["red", "hat"]), (2, ["red"]), (None, ["red"]), (3, ["blue"]), (4, None)]
    index = textindex.TextIndex(spark.createDataFrame(docs, "k int, w array<string>"), "k", "w")
    got = {r.k: r.score for r in index.search(spark.createDataFrame([(1, ["red"])], "q int, w array<string>"), "q", "w", 5).collect()}
    red, fox = math.log(7 / 5), math.log(7 / 2)
    assert got == {1: pytest.approx(2 * red / math.sqrt(2 * red**2 + 2 * fox**2), abs=1e-6), 2: 1.0}


def test_queries_reach_their_cells_in_pieces(spark):
    """A query that asks many cells becomes many rows, each with its vector: no batch holds more than its share."""
    pivots = np.arange(3000.0).reshape(1000, 3)
    frame = pd.DataFrame({"v": [[1.0, 2.0, 3.0]] * 500})
    sizes = [len(f) for f in K.pieces(iter([frame, frame.iloc[:0]]), pivots)]
    assert sum(sizes) == 500 and max(sizes) * len(pivots) <= K.HELD


def test_bisecting_finds_the_raising_rows():
    frame = pd.DataFrame({"n": range(100), "out": None})
    calls = []

    def step(f):
        calls.append(len(f))
        f["out"] = "seen"
        bad = f.index[f["n"].isin([3, 4, 77])]
        if len(bad):
            raise ValueError(f"row {f['n'][bad[0]]}")
        f["out"] = f["n"] * 2
        return f[f["n"] != 50]

    results, raised = P.attempted(frame, step, ["out"])
    assert sorted(raised) == [3, 4, 77] and all("ValueError: row" in m for m in raised.values())
    both = pd.concat(results)
    assert set(both.index) == set(range(100)) - {50} and both["out"][9] == 18 and both["out"][77] == "seen"
    assert len(calls) < 50 and frame["out"].isna().all()


def test_python_steps_in_a_chain(spark):
    rows = [("D", 1, "a", [1.5]), ("D", 2, None, None), ("E", 3, "c", []), ("D", 4, "d", [2.0]), (None, 5, "e", None)]
    docs = spark.createDataFrame(rows, "doc_type string, id int, t string, v array<double>").withColumn("body", F.parse_json(F.lit('{"x":1}')))

    def double(frame, parameters, state):
        frame["v"] = [None if v is None else list(v) * state for v in frame["v"]]
        if (frame["id"] == 4).any():
            raise RuntimeError("four")
        return frame

    steps = [
        P.Step("First", P.constant_field, {"target": "one", "value": 1}),
        P.PythonStep("Double", double, ["id", "v"], {"v": "array<double>"}, {"times": 2}, init=lambda p: p["times"]),
        P.PythonStep("Drop", P.each_document(lambda p, d: None if d["id"] == 1 else {"ok": True}), ["id"], {"ok": "boolean"}),
        P.Step("Last", P.cast_field, {"source": "t", "target": "n", "type": "int"}),
    ]
    got = {r.id: r for r in P.run_chain(docs, {"D": steps}).collect()}
    assert sorted(got) == [2, 3, 4, 5] and got[3]._pipeline == [] and got[5]._pipeline == [] and got[3].ok is None
    assert got[4].v == [2.0, 2.0] and got[2].v is None and got[2].ok and got[4].one == 1
    assert [(s.step_name, s.error) for s in got[4]._pipeline] == [("First", False), ("Double", True), ("Drop", False), ("Last", True)]
    assert "RuntimeError: four" in got[4]._pipeline[1].message and got[4]._pipeline[3].message == "cannot cast 'd' to int"
    assert all(s.start_time <= s.finish_time for s in got[4]._pipeline) and got[4]._pipeline[1].compute_duration_seconds >= 0


def test_dates_in_text(spark):
    cases = {
        "Meeting on Jan. 5th, 2021 at 3pm sharp": dt.datetime(2021, 1, 5, 15), "12:05 am on 2021-03-04": dt.datetime(2021, 3, 4, 0, 5),
        "2 de enero de 2020": dt.datetime(2020, 1, 2), "31/12/1999": dt.datetime(1999, 12, 31), "12/31/99": dt.datetime(1999, 12, 31),
        "Le 1er août 2022 à 09:30:15,250": dt.datetime(2022, 8, 1, 9, 30, 15, 250000), "20210304T050607 ok": dt.datetime(2021, 3, 4, 5, 6, 7),
        "in May 2019 we": dt.datetime(2019, 5, 1), "call 5551234567": None, "maybe 12": None, "": None, None: None, "30 February 2020": None,
        "Tue, 07 Mar 2023 10:00:00 -0800": dt.datetime(2023, 3, 7, 18), "2021-3-4 at 17:00 UTC": dt.datetime(2021, 3, 4, 17),
        "an hour ago": dt.datetime(2023, 12, 31, 23), "in 2 weeks": dt.datetime(2024, 1, 15), "yesterday evening": dt.datetime(2023, 12, 31),
    }
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    found = frame.select("t", dates.scanned(F.col("t"), now=now).cast("timestamp_ntz").alias("d"), dates.scanned(F.col("t"), whole=True).alias("w"))
    got = found.collect()
    assert {r.t: r.d for r in got} == cases
    assert {r.t for r in got if r.w} == {"2 de enero de 2020", "31/12/1999", "12/31/99", "Tue, 07 Mar 2023 10:00:00 -0800", "2021-3-4 at 17:00 UTC", "12:05 am on 2021-03-04"}
    european = frame.where("t like '%99'").select(dates.scanned(F.lit("03/04/2020"), day_first=True).cast("string")).first()[0]
    assert european.startswith("2020-04-03")


def test_summary_and_keywords(spark):
    text = "Foxes run. Foxes and hens run far! Is it late?\nThe hen sleeps.  \n\nNothing here. Foxes sleep."
    docs = spark.createDataFrame([(1, text, "Hens"), (2, "", "x"), (3, None, None), (4, "!!!", "")], "k int, t string, h string")
    got = {r.k: r for r in articles.summarised(docs, F.col("t"), F.col("h"), ["the", "and", "is", "it"]).collect()}
    assert got[1]["__keywords"][:3] == ["foxes", "run", "far"]
    lines = got[1]["__summary"].split("\n")
    assert len(lines) == summaries.SENTENCES and lines[0] == "Foxes run." and "Nothing here." not in lines
    assert got[2]["__keywords"] == [] and got[2]["__summary"] is None and got[3]["__summary"] is None and got[4]["__summary"] == "!!!"


def test_schema_words(spark):
    with pytest.raises(rules.InvalidSchema):
        rules.document_violations({"properties": {"a": {"propertyNames": {}}}}, spark.range(1))
    schema = {
        "type": "object", "x-note": 1, "properties": {"a": {"type": "integer"}}, "patternProperties": {"^s_": {"type": "string"}},
        "additionalProperties": {"type": "number", "minimum": 0},
    }
    bodies = ['{"a":1,"s_x":"t","z":2}', '{"a":1,"z":-1}', '{"s_x":5}', '{"q":"text"}', '{"a":null}']
    frame = spark.createDataFrame([(b,) for b in bodies], "b string").withColumn("v", F.parse_json("b"))
    got = [r[0] for r in frame.select(rules.document_violations(schema, frame, "v")).collect()]
    assert got == [[], ["$: additionalProperties"], ["$: patternProperties ^s_"], ["$: additionalProperties"], ["a: type"]]


def test_circular_references(spark):
    schema = {"$ref": "#/definitions/N", "definitions": {"N": {"properties": {"v": {"type": "integer"}, "l": {"$ref": "#/definitions/N"}, "r": {"$ref": "#"}}}}}
    deep = '{"l":' * 40 + '{"v":"bad","r":{"v":true}}' + "}" * 40
    frame = spark.createDataFrame([(1, '{"v":1}'), (2, deep), (3, '[1]')], "k int, b string").withColumn("v", F.parse_json("b"))
    got = {(r.k, r.violation) for r in rules.recursive_violations(frame, "k", "v", schema).collect()}
    assert got == {(2, "l." * 40 + "v: type"), (2, "l." * 40 + "r.v: type")}
    for wrong in ({"$ref": "#/definitions/none"}, {"$ref": "http://x/y"}, {"not": {"$ref": "#"}}):
        with pytest.raises(rules.InvalidSchema):
            rules.recursive_violations(frame, "k", "v", wrong)


def test_stream_ids(spark, tmp_path):
    """``id`` wins, then ``_id``, then a hash; one that is there but null is rejected."""
    (tmp_path / "in").mkdir()
    lines = ['{"doc_type":"T","id":"a","_id":"z"}', '{"doc_type":"T","_id":"b"}', '{"doc_type":"T","x":1}', '{"doc_type":"T","id":null,"_id":"c"}', '{"doc_type":"T","id":5}']
    (tmp_path / "in" / "docs.json").write_text("\n".join(lines))
    store = DocumentStore(spark, str(tmp_path / "store"))
    stream = ingest.ingest_stream(ingest.document_lines(spark, str(tmp_path / "in")), store, str(tmp_path / "check"), available_now=True)
    stream.awaitTermination()
    ids = {r.id for r in store.current().collect()}
    assert {"a", "b", "5"} <= ids and len(ids) == 4 and any(len(i) == 64 for i in ids)
    assert [r.error_type for r in store.errors().collect()] == ["missing_fields"]


def test_two_writers_with_one_number(spark, tmp_path, monkeypatch):
    """Batches that drew the same number are both kept, and a later one still wins."""
    store = DocumentStore(spark, str(tmp_path / "store"))
    docs = lambda i, v: spark.createDataFrame([("T", i, v)], "doc_type string, id string, v int").select("doc_type", "id", F.to_variant_object(F.struct("v")).alias("body"))
    monkeypatch.setattr(store, "_next_batch", lambda: 1)
    store.put(docs("a", 1), F.current_timestamp())
    store.put(docs("b", 2), F.current_timestamp())
    monkeypatch.undo()
    store.put(docs("a", 3), F.current_timestamp())
    assert {(r.id, r.v) for r in store.view("T", {"v": "int"}).collect()} == {("a", 3), ("b", 2)}
