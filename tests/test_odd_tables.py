"""Catalog queries on tables with repeated addresses and odd texts agree with their SQL."""

import re
from collections import Counter

import compare
import duckdb
import pytest
from pyspark.sql import functions as F

from docloom import session, store
from docloom.functions import text as X
from docloom.operators import ingest, joins, language as L, merge, nearest as K, phrases as H, words as W
from docloom.plans import CATALOG
from docloom.sources import trees

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, folder, name, **tables):
    """Run a query and its SQL on the given tables alone."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    query, sql = CATALOG[name]
    assert compare.differences(query(spark, str(folder)), con, sql) == []


@pytest.mark.parametrize("name", ["article_by_selector", "rescrape_guard"])
def test_addresses_stored_twice(spark, tmp_path, name):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(40)
    again = pages.where("page_id % 3 = 0").selectExpr("page_id + 100000 AS page_id", "url", "replace(html, '<p>', '<p>Again ') AS html")
    same_as_sql(spark, tmp_path, name, pages=pages.unionByName(again))


def test_summaries_of_addresses_stored_twice(spark, tmp_path):
    """Other contents, other titles, equal copies and pages without html of one address."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(40)
    more = lambda n, at, html: pages.where(f"page_id % {n} = 0").selectExpr(f"page_id + {at} AS page_id", "url", f"{html} AS html")
    again = more(3, 100000, "replace(html, '<p>', '<p>Again ')").unionByName(more(4, 200000, "html"))
    again = again.unionByName(more(5, 300000, "replace(html, '<title>', '<title>Other ')")).unionByName(more(7, 400000, "CAST(NULL AS STRING)"))
    same_as_sql(spark, tmp_path, "article_summary", pages=pages.unionByName(again))


def test_model_of_all_words(spark, tmp_path):
    """Texts of stop words alone, of very long words and without words."""
    texts = ["the and of", "x" * 40, "1 2 3", "", None, "some other text of words", "a_b c", "d'une voix"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same_as_sql(spark, tmp_path, "model_registry", documents=docs)


def test_large_lookups_stay_off_the_driver(spark):
    """A broadcast passes through the driver: a vocabulary of 60,000 words is shuffled, a small table is not."""
    facts = spark.range(10).withColumnRenamed("id", "k")
    plan = lambda n: joins.lookup_join(facts, spark.range(n).withColumnRenamed("id", "k"), ["k"])._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in plan(60_000)
    assert "strategy=broadcast" in plan(1000)


def test_large_lookups_are_not_broadcast_by_file_size(spark):
    """A table of 60,000 rows in a small file: Spark takes it for small, though its rows are repeated per salt."""
    facts = session.written(spark.range(200_000).selectExpr("id % 70000 AS k"), "facts")
    lookup = session.written(spark.range(60_000).selectExpr("id AS k", "id + 1 AS n"), "lookup")
    joined = joins.lookup_join(facts, lookup, ["k"])
    assert joined.agg(F.count("n"), F.sum("n")).first()[0] == facts.where("k < 60000").count()
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    kinds = {how: joins.lookup_join(facts, lookup, ["k"], how) for how in ("left", "left_semi", "left_anti")}
    assert not [how for how, df in kinds.items() if "Broadcast" in df._jdf.queryExecution().executedPlan().toString()]


def test_dictionary_counts(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["a", "c"]), (3, ["a"])], "k long, words array<string>")
    got = sorted(tuple(r) for r in W.dictionary_counts(docs, "k", "words").select("token_id", "token", "n_docs", "n").collect())
    assert got == [(0, "a", 3, 3), (1, "b", 1, 2), (2, "c", 1, 1)]


def test_questions_of_a_cell_are_cut_into_lots(spark, monkeypatch):
    """No group holds more questions than a lot, give or take the hash; answers stay the same."""
    rows = spark.createDataFrame([(i, [float(i % 37), float(i % 11)]) for i in range(300)], "k long, v array<double>")
    asked = rows.selectExpr("k AS q", "v AS w")
    whole = {tuple(r) for r in K.nearest_many(rows, "v", "k", asked, "q", "w", 5).collect()}
    monkeypatch.setattr(K, "ASKED", 20)
    cut = K.nearest_many(rows, "v", "k", asked, "q", "w", 5)
    assert "lot" in cut._jdf.queryExecution().analyzed().toString()
    assert {tuple(r) for r in cut.collect()} == whole


@pytest.mark.parametrize("n", [1, 3, 30])
def test_gram_counts(spark, n):
    """Grams never cross texts, also when their numbers outgrow 62 bits; short texts and wide characters count as they should."""
    texts = ["", "a", "Ab  ab\nAB", "\U0001d518ß\U0001d518ß\U0001d518ß", " ".join(f"w{i}" for i in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1)
    got = {(r["k"], r["gram"]): r["n"] for r in L.gram_counts(docs, ["k"], "t", n).collect()}
    flat = [f" {' '.join(re.split(r'[ \n]+', t)).lower()} " for t in texts]
    assert got == Counter((k, t[i : i + n]) for k, t in enumerate(flat) for i in range(len(t) - n + 1))


def test_tree_is_read_by_its_manifest(spark, tmp_path):
    """The manifest stands for a listing: same documents and files, and Spark's own lister, which runs on the driver, is not asked."""
    docs = spark.createDataFrame([("Web Page", "1", "x"), ("Web Page", "ü/2", None)], "doc_type string, id string, t string")
    files = spark.createDataFrame([("Web Page", "1", "raw", "a b.txt", b"one"), ("Web Page", "ü/2", "raw", "c.bin", b"")], "doc_type string, id string, artifact_type string, filename string, content binary")
    root = str(tmp_path / "tree")
    manifest = trees.write_document_tree(docs, root, files)
    tree = trees.read_document_tree(spark, root, manifest)
    beside = trees.attach_files(tree, spark, root, content=True, listed=manifest)
    assert "binaryFile" not in beside._jdf.queryExecution().analyzed().toString()
    got = sorted((r["id"], r["artifact_type"], r["filename"], r["length"], bytes(r["content"])) for r in beside.collect())
    assert got == [("1", "raw", "a b.txt", 3, b"one"), ("ü/2", "raw", "c.bin", 0, b"")]
    assert sorted(r["id"] for r in tree.collect()) == [r["id"] for r in trees.read_document_tree(spark, root).orderBy("id").collect()]


def test_folds_hold_a_bounded_number_of_changes_a_task(spark, monkeypatch):
    """A log in few parts is dealt into many, also one that is all of one key; the state stays the same."""
    log = spark.range(4000).coalesce(1).selectExpr(
        "'T' AS doc_type", "if(id % 3 = 0, 0, id % 50) AS id", "id AS seq", "'update' AS op",
        "parse_json(concat('{\"a\":', id, ',\"b\":{\"c', id % 2, '\":', id % 7, '}}')) AS body")
    state = lambda: sorted((r["id"], r["j"]) for r in merge.fold_documents(log).selectExpr("id", "to_json(body) AS j").collect())
    whole = state()
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    dealt = session.even(log, "id", "seq")
    assert dealt.rdd.getNumPartitions() == 40 and max(map(len, dealt.rdd.glom().collect())) < 200
    assert "RepartitionByExpression" in merge.fold_documents(log)._jdf.queryExecution().analyzed().toString()
    assert state() == whole


def test_field_families_are_hashed(spark):
    """Families are numbers while they are aggregated, so no task sorts all its leaves."""
    docs = spark.sql("SELECT 'T' AS doc_type, id AS seq, parse_json(if(id = 0, '{\"a\":\"x\",\"o\":{\"p\":true}}', '{\"a\":1,\"z\":[2]}')) AS body FROM range(5)")
    found = ingest.field_families(docs)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["path"], r["family"]) for r in found.collect()} == {("a", "text"), ("o", "object"), ("o.p", "boolean"), ("z", "number")}


def test_tokens_of_cleaned_texts(spark):
    """Splitting the unsqueezed text gives the tokens of the cleaned one."""
    texts = ["", None, "  ", "a@b.c", "mail me@x.org\tnow", "don't  'do' it", "É́té   Straße_x", "_a __ b_", "ΟΔΟΣ ΣΑΣ\u0085Σ",
             "x" * 16 + " " + "y" * 15 + " z", "İstanbul K ½ Ⅷ 12ab", "tab\there\n\nthere\x1cend", "日本 ガ ガ", "me@x you 're"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    cleaned = X.clean_text(F.col("t"))
    plain = F.filter(
        F.regexp_extract_all(F.regexp_replace(F.translate(F.lower(cleaned), *X.accent_table()), r"\p{Mn}", ""), F.lit(X.TOKEN_PATTERN), F.lit(0)),
        lambda t: F.length(t).between(2, 15) & ~t.startswith("_"),
    )
    for fast, slow in df.select(X.clean_tokens(F.col("t")), plain).collect():
        assert fast == slow


@pytest.mark.parametrize("bound", [joins.BROADCAST_ROWS, 1])
def test_lemma_totals(spark, monkeypatch, bound):
    """Repeated and null keys, words of one lemma, words with several entries, dropped parts of speech and stop words."""
    monkeypatch.setattr(joins.lookup_join, "__defaults__", ("inner", bound, joins.SALTS))
    entries = [("cats", "cat", "NOUN"), ("dog", "dog", "NOUN"), ("dogs", "dog", "NOUN"), ("ran", "run", "VERB"), ("ran", "run", "NOUN"),
               ("ran", "ran", "NOUN"), ("the", "the", "DET"), ("is", "be", "VERB"), ("red", None, "ADJ"), ("hot", "hot", None)]
    rows = [(1, "cat cats dog dogs dogs".split()), (1, "cat new new".split()), (None, "cat ran red".split()), (2, "ran run the is be hot".split()),
            (3, []), (4, None), (5, "new dogs red red hot".split())]
    lexicon = spark.createDataFrame(entries, "word string, lemma string, pos string")
    for part in (rows, rows[1:]):  # with and without a repeated key
        docs = spark.createDataFrame(part, "k long, words array<string>")
        spots = W.lemmatize(docs, "k", "words", lexicon, stop=["be"])
        plain = spots.groupBy("lemma").agg(F.count("*"), F.count_distinct("k"), F.sum("position"))
        found = W.lemma_totals(docs, "k", "words", lexicon, stop=["be"]).select("lemma", "n", "n_docs", "places")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_each_token_is_counted_once_for_phrases(spark, monkeypatch):
    """Words are summed from the pairs they begin, the last token has none."""
    kept = {}
    monkeypatch.setattr(H, "written", lambda df, label: kept.setdefault(label, df))
    rows = [(["a", "b", "a", "b"],), (["c"],), ([],), (None,), (["a", "b", "c"],)]
    found = H.scored_pairs(spark.createDataFrame(rows, "w array<string>"), "w", 1, 0.0).collect()
    assert kept["pair-counts"].agg(F.sum("n")).first()[0] == 8
    # 3 words and the pairs ab, ba, bc
    assert [tuple(r) for r in found] == [("a", "b", 3, 3, 3, (3 - 1) * 6 / 9)]


def test_snapshots_are_not_folded_again(spark, tmp_path):
    """Right behind a snapshot its rows are the state, also after a drop; a newer batch is folded on top."""
    held = store.DocumentStore(spark, str(tmp_path / "store"))
    now = F.to_timestamp(F.lit("2024-06-01 12:00:00"))
    rows = lambda sql: spark.sql(f"SELECT t AS doc_type, i AS id, parse_json(b) AS body FROM VALUES {sql} AS v(t, i, b)")
    state = lambda: sorted((r["doc_type"], r["id"], r["j"]) for r in held.current().selectExpr("doc_type", "id", "to_json(body) AS j").collect())
    folds = lambda: held.current()._jdf.queryExecution().analyzed().toString().count("Aggregate [")
    held.put(rows("""('A', '1', '{"x":1,"o":{},"n":null}'), ('A', '1', '{"o":{"p":[1,{}]}}'), ('a', '2', '{}'), ('B', '1', '{"x":1.50}')"""), now)
    held.delete(rows("('a', '2', 'null')"), now)
    before = state()
    assert folds() > 0 and [r[:2] for r in before] == [("A", "1"), ("B", "1")]
    held.compact(now)
    assert folds() == 0 and state() == before
    held.drop("b")
    assert folds() == 0 and state() == before[:1]
    held.put(rows("""('A', '1', '{"x":2}'), ('B', '3', '{}')"""), now)
    after = state()
    assert folds() > 0 and [r[:2] for r in after] == [("A", "1"), ("B", "3")] and '"x":2' in after[0][2] and '"p":[1,{}]' in after[0][2]
