"""Operator semantics on small fixtures, against brute force where SQL is not at hand."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import predicates as Q, scalars as X, text as TX, variants as V
from docloom.operators import (
    articles, chain, graph, ingest, joins, language, merge, phrases, rules, runs, schemas, search,
    spans, topics, vectors, words,
)
from docloom.session import fresh_dir, written
from docloom.sources import artifacts, trees
from docloom.store import DocumentStore
from docloom.streaming import topics as streaming_topics

NOW = "2024-06-01 12:00:00"


def now():
    return F.to_timestamp(F.lit(NOW))


def bodies(spark, rows):
    """Documents from ``(doc_type, id, dict)``, kept in order."""
    data = [(i, t, d, json.dumps(b)) for i, (t, d, b) in enumerate(rows)]
    frame = spark.createDataFrame(data, "n long, doc_type string, id string, j string")
    return frame.withColumn("body", F.parse_json("j")).drop("j")


def as_dict(frame):
    rows = frame.select("id", F.to_json("body").alias("j")).collect()
    return {r["id"]: json.loads(r["j"]) for r in rows}


# -- merge ---------------------------------------------------------------------------------------


def deep_merge(old, new):
    for k, v in new.items():
        if isinstance(v, dict) and isinstance(old.get(k), dict):
            deep_merge(old[k], v)
        else:
            old[k] = json.loads(json.dumps(v))
    return old


def random_value(rng, depth):
    kind = rng.choice(["num", "text", "null", "list", "obj", "obj"])
    if kind == "obj" and depth:
        return {rng.choice("abc"): random_value(rng, depth - 1) for _ in range(rng.randint(0, 2))}
    return {"num": rng.randint(0, 9), "text": 'q"\\x', "null": None, "list": [1, {"z": 2}]}.get(kind, True)


def test_fold_equals_sequential_replay(spark):
    rng = random.Random(7)
    rows, state = [], {}
    for seq in range(600):
        key = str(rng.randint(0, 30))
        op = rng.choice(["update"] * 6 + ["index", "delete"])
        body = {rng.choice("abcd"): random_value(rng, 3) for _ in range(rng.randint(0, 3))}
        rows.append(("T", key, seq, op, None if op == "delete" else json.dumps(body)))
        if op == "delete":
            state.pop(key, None)
        elif op == "index":
            state[key] = body
        else:
            state[key] = deep_merge(state.get(key, {}), body)
    log = spark.createDataFrame(rows, "doc_type string, id string, seq long, op string, j string")
    got = as_dict(merge.fold_documents(log.withColumn("body", F.parse_json("j"))))
    assert got == state


def test_leaves_open_every_level_and_report_the_limit(spark):
    deep = '{"a":' * 6 + "1" + "}" * 6
    frame = spark.createDataFrame([(deep,)], "j string").select(F.parse_json("j").alias("body"))
    path = frame.select(V.path_text(V.leaves("body")[0]["path"]), V.too_deep(V.leaves("body", 3)))
    assert tuple(path.first()) == ("a.a.a.a.a.a", True)


def test_updates_far_down_merge(spark):
    nest = lambda inner: '{"a":' * 25 + inner + "}" * 25
    rows = [("T", "k", s, "update", nest(j)) for s, j in enumerate(('{"x":1,"y":[1]}', '{"y":2}'))]
    log = spark.createDataFrame(rows, "doc_type string, id string, seq long, op string, j string")
    got = as_dict(merge.fold_documents(log.withColumn("body", F.parse_json("j"))))
    assert got == {"k": json.loads(nest('{"x":1,"y":2}'))}


def test_columns_nest_by_their_names(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "`a.b.c` int, `a.d` int, e int")
    assert X.nest_columns(frame).first().asDict(True) == {"a": {"b": {"c": 1}, "d": 2}, "e": 3}
    with pytest.raises(ValueError):
        X.nest_columns(spark.createDataFrame([(1, 2)], "`a` int, `a.b` int"))


# -- store ---------------------------------------------------------------------------------------


def test_upsert_get_delete(spark):
    store = DocumentStore(spark, fresh_dir(spark, "t"))
    doc = [("TestDocument", "x1", {"corpus": "test"})]
    store.put(bodies(spark, doc), now(), order="n")
    view = store.view("testdocument", {"corpus": "string"})
    assert [tuple(r) for r in search.get(view, "x1").collect()] == [("TestDocument", "x1", "test")]
    assert store.type_exists("TestDocument") and not store.type_exists("Other")
    store.delete_by_query("TestDocument", {}, Q.match("id", "x1"), now())
    assert store.current().count() == 0


def test_partial_update_keeps_absent_fields_and_stamps(spark):
    store = DocumentStore(spark, fresh_dir(spark, "t"))
    store.put(bodies(spark, [("T", "1", {"a": {"x": 1}, "b": 2, "_op_type": "q"})]), now(), session="s1")
    store.put(bodies(spark, [("T", "1", {"a": {"y": 3}, "b": None})]), now(), session="s2")
    got = as_dict(store.current())["1"]
    assert got["a"] == {"x": 1, "y": 3} and got["b"] is None and "_op_type" not in got
    assert got["analytic_session_id"] == ["s2"] and got["id"] == "1"
    newest = store.compact(now())
    assert as_dict(store.current())["1"] == got and newest == 2


def test_mapping_conflict_keeps_coercible_values(spark):
    values = [1, {"x": 2}, "3", {"x": 4}]
    docs = [("Conflict", str(i + 1), {"value": v}) for i, v in enumerate(values)]
    store = DocumentStore(spark, fresh_dir(spark, "t"))
    store.put(bodies(spark, docs), now(), order="n")
    assert sorted(as_dict(store.current())) == ["1", "3"]
    assert {r["id"] for r in store.errors().collect()} == {"2", "4"}
    # a later batch is held to what the first one decided
    store.put(bodies(spark, [("Conflict", "5", {"value": {"x": 1}})]), now(), order="n")
    assert sorted(as_dict(store.current())) == ["1", "3"]
    strict = DocumentStore(spark, fresh_dir(spark, "t"))
    with pytest.raises(ingest.IngestError):
        strict.put(bodies(spark, docs), now(), order="n", strict=True)
    assert strict.current().count() == 0


def test_schema_validation_skips_or_raises(spark):
    schema = {"NewsArticle": {"properties": {"url": {"type": "string"}}, "required": ["id", "url"]}}
    docs = [
        ("NewsArticle", "1", {"doc_type": "NewsArticle", "id": "1", "url": "foo.com"}),
        ("NewsArticle", "2", {"doc_type": "NewsArticle", "id": "2", "url": None}),
        ("NewsArticle", "3", {"doc_type": "NewsArticle", "id": "3", "url": "bar.com"}),
        ("Other", "", {"doc_type": "Other"}),
    ]
    store = DocumentStore(spark, fresh_dir(spark, "t"))
    store.put(bodies(spark, docs), now(), schemas=schema, order="n")
    assert sorted(as_dict(store.current())) == ["1", "3"]
    bad = {(r["error_type"], r["message"]) for r in store.errors().collect()}
    assert bad == {("jsonschema", "url: type"), ("missing_fields", "id missing")}
    with pytest.raises(ingest.IngestError):
        store.put(bodies(spark, docs), now(), schemas=schema, strict=True)


def test_drop_and_case_insensitive_collections(spark):
    store = DocumentStore(spark, fresh_dir(spark, "t"))
    store.put(bodies(spark, [("Foo", "1", {"a": 1}), ("foo", "2", {"a": 1}), ("Bar", "3", {"a": 1})]), now())
    assert store.current("FOO").count() == 2
    store.drop("Foo")
    assert sorted(as_dict(store.current())) == ["3"]
    store.put(bodies(spark, [("Foo", "4", {"a": {"now": "an object"}})]), now())
    assert sorted(as_dict(store.current())) == ["3", "4"]


# -- rules ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "schema, value, ok",
    [
        ({"type": "integer"}, 3, True),
        ({"type": "integer"}, 3.0, True),
        ({"type": "integer"}, 3.5, False),
        ({"type": "string"}, None, False),
        ({"type": "string", "nullable": True}, None, True),
        ({"enum": ["a", 1]}, 1, True),
        ({"enum": ["a", 1]}, "b", False),
        ({"minimum": 2, "exclusiveMinimum": True}, 2, False),
        ({"multipleOf": 0.5}, 1.5, True),
        ({"pattern": "^a+$"}, "aab", False),
        ({"minItems": 2}, [1], False),
        ({"uniqueItems": True}, [1, 2, 1], False),
        ({"items": {"type": "integer"}}, [1, "x"], False),
        ({"items": {"required": ["k"]}}, [{"k": 1}, {}], False),
        ({"maxProperties": 1}, {"a": 1, "b": 2}, False),
        ({"properties": {"a": {}}, "additionalProperties": False}, {"b": 1}, False),
        ({"oneOf": [{"type": "string"}, {"minimum": 3}]}, 5, True),
        ({"oneOf": [{"type": "number"}, {"minimum": 3}]}, 5, False),
        ({"not": {"type": "string"}}, "x", False),
        ({"required": ["a"]}, {"a": None}, True),
    ],
)
def test_rule(spark, schema, value, ok):
    body = json.dumps({"v": value})
    frame = spark.createDataFrame([(body,)], "j string").select(F.parse_json("j").alias("body"))
    whole = {"properties": {"v": schema}}
    found = frame.select(rules.document_violations(whole, frame, "body").alias("r")).first()["r"]
    assert (found == []) is ok


def test_schema_merge_and_references():
    merged = rules.merge_schemas(
        {"required": ["doc_type"], "properties": {"a": {"type": "string"}}, "tags": [1]},
        {"required": ["id"], "properties": {"a": {"nullable": True}}, "tags": [2]},
    )
    assert merged == {
        "required": ["doc_type", "id"],
        "properties": {"a": {"type": "string", "nullable": True}},
        "tags": [2],
    }
    assert rules.resolve_refs({"x": {"$ref": "#/definitions/d"}}, {"d": {"type": "array"}}) == {
        "x": {"type": "array"}
    }
    with pytest.raises(rules.InvalidSchema):
        rules.resolve_refs({"$ref": "#/links/none"}, {})


# -- text ----------------------------------------------------------------------------------------


def test_clean_and_tokens(spark):
    text = "Écrire  à jo.e@x.org now: l'été_2 _x a " + "z" * 16
    frame = spark.createDataFrame([(text,)], "t string")
    cleaned, toks = frame.select(TX.clean_text(F.col("t")), TX.tokens(F.col("t"))).first()
    assert cleaned == "Écrire à now: lété_2 _x a " + "z" * 16
    assert toks == ["ecrire", "jo", "org", "now", "ete_"]


def test_greedy_phrases(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "c", "x", "a", "b"]), (2, []), (3, ["b"])], "k int, w array<string>")
    found = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    got = {r["k"]: r["w"] for r in phrases.apply_phrases(docs, "k", "w", found).collect()}
    assert got == {1: ["a_b", "c", "x", "a_b"], 2: [], 3: ["b"]}


def test_phrases_are_merged_in_their_row(spark):
    """No text and no position moves, whatever the number of phrases; keys may repeat or be null, texts be null or without pairs."""
    rows = [(1, ["a", "b", "c"], "x"), (1, ["c", "a", "b"], "y"), (None, ["b", "c"], "z"), (2, None, None), (3, [], ""), (4, ["b", "a"], "w"), (5, ["c", "b", "c", "c", "b", "c"], "v")]
    docs = spark.createDataFrame(rows, "k int, w array<string>, other string")
    many = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "b"), *[(f"p{i}", "q") for i in range(1000)]], "a string, b string")
    found = phrases.apply_phrases(docs, "k", "w", many)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["k"], r["w"], r["other"]) for r in found.collect()] == [
        (1, ["a_b", "c"], "x"), (1, ["c", "a_b"], "y"), (None, ["b_c"], "z"), (2, None, None), (3, [], ""), (4, ["b", "a"], "w"), (5, ["c", "b_c", "c", "b_c"], "v"),
    ]
    none = phrases.apply_phrases(docs, "k", "w", many.where("false"))
    assert [r["w"] for r in none.collect()] == [r[1] for r in rows]


def test_spans_have_code_point_offsets(spark):
    text = "né 12 🎉 34 Written by Gabe." + " 5" * 2500
    frame = spark.createDataFrame([(1, text)], "id int, t string")
    rows = spans.pattern_spans(frame, "id", "t", [("N", r"\d+")]).orderBy("start_char").collect()
    assert len(rows) == 2502
    assert all(text[r["start_char"] : r["end_char"]] == r["text"] for r in rows)
    names = spark.createDataFrame([("gabe", "PERSON")], "term string, label string")
    found = spans.gazetteer_spans(frame, "id", "t", names).collect()
    assert [(r["label"], r["text"], text[r["start_char"] : r["end_char"]]) for r in found] == [
        ("PERSON", "Gabe", "Gabe")
    ]


def test_spans_step_skips_present_target(spark):
    frame = spark.createDataFrame([("D", "a1", None), ("D", "b2", "x")], "doc_type string, t string, o string")
    frame = spans.find_spans(frame, "t", [("N", r"\d")], "found")
    step = chain.Step("Spans", spans.spans_step("found"), {"source": "t", "target": "refs"})
    out = chain.run_chain(frame, {"D": [step, step]})
    row = out.orderBy("t").first()
    assert row["refs"][0]["text"] == "1" and [s["skipped"] for s in row["_pipeline"]] == [False, True]


def test_window_counts_against_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, [rng.choice("abcdefgh") for _ in range(n)]) for i, n in enumerate([0, 1, 4, 5, 6, 30])]
    want: dict = {}
    for _, toks in docs:
        for s in range(max(len(toks) - 5, 0) + 1 if toks else 0):
            held = sorted(set(toks[s : s + 5]) & set("abc"))
            for x in held:
                for y in held:
                    if x <= y:
                        want[x, y] = want.get((x, y), 0) + 1
    frame = spark.createDataFrame(docs, "k int, w array<string>")
    got = topics.window_counts(frame, "k", "w", ["a", "b", "c"], width=5).collect()
    assert {(r["a"], r["b"]): r["n_windows"] for r in got} == want


def test_bags_and_dense_ids(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["c"])], "k int, w array<string>")
    got = {(r["k"], r["token"]): r["n"] for r in words.bag_of_words(docs, "k", "w").collect()}
    assert got == {(1, "b"): 2, (1, "a"): 1, (3, "c"): 1}
    many = spark.range(1000).select(F.format_string("v%04d", "id").alias("v"))
    ids = words.dense_ids(many, "v").orderBy("v").collect()
    assert [r["token_id"] for r in ids] == list(range(1000))


def test_language_detection(spark):
    rows = [(1, "en", "the cat and the dog"), (2, "de", "der hund und die katze"), (3, None, "the dog")]
    docs = spark.createDataFrame(rows, "id int, lang string, t string")
    profile = language.train(docs, "lang", "t", 3)
    found = {r["id"]: r for r in language.detect(docs, "id", "t", profile).collect()}
    assert profile.floor[0] == "en" and [found[i]["language"] for i in (1, 2, 3)] == ["en", "de", "en"]
    assert math.isclose(sum(found[3]["scores"].values()), 1.0)


def test_topic_model_round_trip(spark):
    docs = spark.createDataFrame(
        [(i, "cat dog mouse pet animal" if i % 2 else "stock bond market trade price") for i in range(40)],
        "id int, t string",
    )
    prepared = written(topics.prepared(docs, "id", "t", []), "prepared")
    model = topics.train(prepared, num_topics=2, passes=5)
    root = fresh_dir(spark, "models")
    entry = topics.save_model(model, root, "Topics", "one", now()).first()
    again = topics.load_model(root, "Topics", "one")
    assert entry["doc_type"] == "Model" and topics.perplexity_bound(again, prepared) < 0
    tops = topics.topic_words(again, 3).collect()
    assert len(tops) == 6 and topics.topics_for(again, prepared, "id", 0.5).count() == 40


# -- web, graph, vectors ---------------------------------------------------------------------------


def test_article_reader(spark):
    page = (
        '<html lang="en"><head><title>T &amp; t</title><meta name="author" content="Ann">'
        "<style>p{}</style></head><body><nav>menu</nav><div>side</div><article><h1>Head</h1>"
        '<p>One <b>two</b>.</p><script>var x="</p>";</script></article><footer>foot</footer></body></html>'
    )
    rows = [("http://a.org/1", page), ("http://a.org/2", "<p>plain"), ("http://a.org/3", None)]
    frame = spark.createDataFrame(rows, "url string, html string")
    got = {r["url"][-1]: r for r in articles.extract_articles(frame).collect()}
    assert got["1"]["content"] == "Head\n\nOne two." and got["1"]["authors"] == ["Ann"]
    assert got["1"]["title"] == "T & t" and got["1"]["meta_lang"] == "en"
    assert got["2"]["content"] == "plain" and got["2"]["title"] == "http://a.org/2"
    assert got["3"]["scrape_error"] and not got["3"]["scrape_status"]
    picked = articles.extract_articles(frame.limit(1), xpaths=["/html/body/article/p", "/html/body"])
    assert "side" in picked.first()["content"]
    assert articles._steps("//body/*/div[2]") == [("body", None), ("*", None), ("div", 2)]
    with pytest.raises(ValueError):
        articles._steps("/html/div[@id]")


def test_graph_paths_and_falsy_values(spark):
    rows = [
        (1, "open", False, {"login": "ann"}, [{"filename": "f1"}, {"filename": None}], ["", "t"]),
        (2, "", True, {"login": ""}, [], None),
    ]
    docs = spark.createDataFrame(
        rows,
        "id int, state string, locked boolean, user struct<login:string>, "
        "files array<struct<filename:string>>, tags array<string>",
    ).withColumn("doc_type", F.lit("Pull"))
    edge = {"type": "edge", "target_id": "id"}
    config = {
        "Pull": {
            "fields": [
                {"type": "property", "name": "id", "path": "id", "index": True},
                {"type": "property", "name": "state", "path": "state", "default": "none"},
                {"type": "property", "name": "locked", "path": "locked"},
                {**edge, "edge_label": "HAS_USER", "target_vertex_label": "User", "path": "user.login"},
                {
                    **edge, "edge_label": "CHANGED", "target_vertex_label": "File", "path": "files[]",
                    "target_property_fields": [{"name": "id", "path": "filename"}],
                },
                {**edge, "edge_label": "TAG", "target_vertex_label": "Tag", "path": "tags"},
            ]
        }
    }
    v = {r["id"]: r["props"] for r in graph.vertices(docs, config, "Pull").collect()}
    assert v == {"1": {"state": "open", "locked": ""}, "2": {"state": "none", "locked": "true"}}
    e = {(r["src_id"], r["edge"], r["dst_id"]) for r in graph.edges(docs, config, "Pull").collect()}
    assert e == {("1", "HAS_USER", "ann"), ("1", "CHANGED", "f1"), ("1", "TAG", ""), ("1", "TAG", "t")}
    assert graph.indexed_properties(config)[0] == ("Pull", "id")


def test_nearest_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(8)]) for i in range(200)]
    query = [0.5] * 8
    frame = spark.createDataFrame(rows, "id int, v array<float>")
    got = [r["id"] for r in vectors.nearest(frame, "v", "id", query, 5).collect()]
    held = {r["id"]: r["v"] for r in frame.collect()}
    want = sorted(held, key=lambda i: (sum((a - 0.5) ** 2 for a in held[i]), i))[:5]
    assert got == want


def test_schema_links():
    found = schemas.schema_link_edges(
        {
            "A": {
                "properties": {
                    "src": {"$ref": "#/links/s"},
                    "all": {"type": "array", "items": {"$ref": "#/definitions/d"}},
                },
                "definitions": {"d": {"properties": {"inner": {"$ref": "#/links/s"}}}},
            }
        },
        {"s": {"properties": {"doc_type": {"enum": ["X", "Y"]}}}},
    )
    assert ("A", "src", "X", "single") in found and ("A", "inner", "Y", "multiple") in found


# -- helpers, sources, runs ------------------------------------------------------------------------


def test_lookup_join_strategies_agree(spark):
    facts = spark.range(2000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(0, 2000, 3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        small = joins.lookup_join(facts, table, ["k"], how).collect()
        large = joins.lookup_join(facts, table, ["k"], how, broadcast_rows=10, salts=4).collect()
        assert sorted(map(tuple, small), key=repr) == sorted(map(tuple, large), key=repr)


def test_dates():
    assert X.java_pattern("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"
    with pytest.raises(ValueError):
        X.java_pattern("%Q")


def test_content_types_and_artifact_paths(spark):
    stored = spark.createDataFrame(
        [("TestDocument", "a/b", "file", "test.txt", 10, 1), ("TestDocument", "a/b", "file", "test.txt", 99, 2)],
        "doc_type string, id string, artifact_type string, filename string, file_size long, seq int",
    )
    row = artifacts.registry(stored, "default").collect()
    assert len(row) == 1 and row[0]["content_type"] == "text/plain" and row[0]["file_size"] == 99
    assert row[0]["remote_path"] == "default/artifacts/TestDocument/a%2Fb/file"
    assert row[0]["remote_file_path"] == row[0]["remote_path"] + "/test.txt"


def test_document_tree_with_files(spark, tmp_path):
    folder = tmp_path / "T" / "k1"
    (folder / "artifacts" / "file").mkdir(parents=True)
    (folder / "doc.json").write_text('{"doc_type": "T",\n "id": "1"}')
    (folder / "artifacts" / "file" / "a.txt").write_bytes("né".encode("latin-1"))
    (folder / "artifacts" / "file" / ".b.swp").write_text("x")
    tree = trees.read_document_tree(spark, str(tmp_path))
    with_files = trees.attach_files(tree, spark, str(tmp_path)).collect()
    assert [(r["id"], r["artifact_type"], r["filename"]) for r in with_files] == [("1", "file", "a.txt")]
    scan = artifacts.scan_folder(spark, str(folder / "artifacts" / "file"), skip=["b"], with_content=True)
    assert scan.select(artifacts.decode_text(F.col("content"))).first()[0] == "né"


def test_topic_filters():
    import re

    def hit(pattern, topic):
        rx = streaming_topics.topic_regex(pattern).replace("\\Q", "").replace("\\E", "")
        return re.match(rx, topic) is not None

    assert hit("a/+/b/#", "a/x/b") and hit("a/+/b/#", "a/x/b/c/d") and hit("#", "any/thing")
    assert not hit("a/+/b/#", "a/x/y/b") and not hit("a/+", "a/b/c")
    with pytest.raises(ValueError):
        streaming_topics.topic_regex("a/#/b")


def test_run_job_books_success_and_failure(spark):
    log, out = fresh_dir(spark, "runs"), fresh_dir(spark, "out")
    schema = {"properties": {"n": {"type": "integer"}}, "required": ["n"]}
    job = lambda s, p: s.range(p["n"])
    assert runs.run_job(spark, log, "echo", "s1", job, {"n": 3}, schema, out).count() == 3
    with pytest.raises(ValueError):
        runs.run_job(spark, log, "echo", "s2", job, {"n": "x"}, schema)
    latest = {
        r["analytic_session_id"]: r
        for r in runs.latest_status(spark.read.parquet(log), F.struct("ts", "finished")).collect()
    }
    assert latest["s1"]["finished"] and not latest["s1"]["error"] and latest["s1"]["n_out"] == 3
    assert latest["s2"]["error"] and "n: type" in latest["s2"]["message"]


def test_must_not_keeps_missing(spark):
    frame = spark.createDataFrame([(1, True, ["a"]), (2, None, []), (3, False, None)], "id int, f boolean, t array<string>")
    kept = search.query(frame, Q.must_not(Q.term("f", True))).select("id").collect()
    assert sorted(r["id"] for r in kept) == [2, 3]
    assert [r["id"] for r in search.query(frame, Q.exists("t")).collect()] == [1]
    assert [r["id"] for r in search.query(frame, Q.term("t", "a")).collect()] == [1]
