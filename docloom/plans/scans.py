"""Scans, predicates, point and page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import bool_query, exists, match, match_all, must, must_not, term
from ..operators import articles as A, search as S
from ..session import spread
from .registry import register, table


@register("""
SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100
""")
def scan_project_limit(spark, sf):
    return S.query(
        table(spark, sf, "documents"),
        term("lang", "en"),
        size=100,
        order="doc_id",
        source=["doc_id", "source", "n_chars"],
    )


@register("""
SELECT source AS doc_type, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents WHERE source LIKE 'src1%' GROUP BY source
""")
def scan_types(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("source", "doc_type")
    return (
        S.of_types(docs, "src1*")
        .groupBy("doc_type")
        .agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"))
    )


@register("SELECT p_partkey, p_name, p_brand, p_size FROM part")
def field_projection(spark, sf):
    return S.project(
        table(spark, sf, "part"), include=["p_*"], exclude=["*_type", "p_retail*"]
    )


@register("""
SELECT 'all' AS query, count(*) AS n FROM documents
UNION ALL SELECT 'english', count(*) FROM documents WHERE lang = 'en'
UNION ALL SELECT 'english or missing label', count(*) FROM documents WHERE lang = 'en' AND n_chars > 0
""")
def hit_counts(spark, sf):
    docs = table(spark, sf, "documents")
    wanted = {
        "all": match_all(),
        "english": term("lang", "en"),
        "english or missing label": must(term("lang", "en"), lambda df: F.col("n_chars") > 0),
    }
    out = None
    for name, clause in wanted.items():
        one = S.count(docs, clause).select(F.lit(name).alias("query"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@register("""
WITH u AS (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY user_id)
SELECT user_id, CAST(len(kinds) AS INTEGER) AS n_kinds FROM u WHERE list_contains(kinds, 'purchase')
""")
def term_on_array(spark, sf):
    # a set of event types per user: bounded by the number of types, not of events
    users = table(spark, sf, "events").groupBy("user_id").agg(
        F.collect_set("event_type").alias("kinds")
    )
    return S.query(users, term("kinds", "purchase")).select(
        "user_id", F.size("kinds").alias("n_kinds")
    )


@register("""
SELECT d.doc_id, d.source, coalesce(l.quality, -1) AS quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE d.lang IS NOT NULL AND d.n_chars >= 200 AND coalesce(l.toxic, 0) <> 1
""")
def bool_must_not(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    clause = bool_query(
        [exists("lang"), lambda df: F.col("n_chars") >= 200], [term("toxic", 1)]
    )
    return S.query(docs, clause).select(
        "doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality")
    )


@register(r"""
SELECT doc_id, source FROM documents
WHERE list_has_any(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'),
                   ['thorat', 'nicht', 'cióngañ', 'eaux'])
""")
def match_tokens(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return S.query(docs, match("text", "Thorat, NICHT; cióngañ eaux"), source=["doc_id", "source"])


@register("""
SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 7
""")
def point_get(spark, sf):
    return S.get(
        table(spark, sf, "customer"), 7, key="c_custkey", source=["c_custkey", "c_name", "c_mktseg*"]
    )


@register("""
WITH r AS (
  SELECT o_orderkey * 2 AS pos, o_custkey AS c_custkey FROM orders
  UNION ALL SELECT o_orderkey * 2 + 1, o_orderkey FROM orders)
SELECT r.pos, c.c_custkey, c.c_name FROM r JOIN customer c ON r.c_custkey = c.c_custkey
""")
def multi_get(spark, sf):
    # every order asks for its customer and for a customer with the order's number: repeated
    # and unknown ids at any scale
    orders = table(spark, sf, "orders")
    asked = orders.select(
        F.posexplode(F.array("o_custkey", "o_orderkey")).alias("i", "c_custkey"), "o_orderkey"
    ).select((F.col("o_orderkey") * 2 + F.col("i")).alias("pos"), "c_custkey")
    customers = S.project(table(spark, sf, "customer"), source=["c_custkey", "c_name"])
    return S.multi_get(customers, asked, "c_custkey", "pos")


@register("""
SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
""")
def existing_ids(spark, sf):
    asked = table(spark, sf, "customer").select("c_custkey")
    stored = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return S.existing(asked, stored, "c_custkey")


@register(r"""
WITH l AS (
  SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS url
  FROM (SELECT url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"#]+)', 1)) AS href FROM pages))
SELECT url FROM l WHERE url NOT IN (SELECT url FROM pages)
""")
def bulk_missing(spark, sf):
    pages = table(spark, sf, "pages")
    links = pages.select("url", F.explode(A.page_links(F.col("html"))).alias("href")).select(
        F.concat(A.site_of(F.col("url")), "href").alias("url")
    )
    return S.not_stored(links.distinct(), pages, "url")


@register("""
WITH w AS (SELECT DISTINCT r_name AS doc_type FROM region UNION SELECT DISTINCT c_mktsegment FROM customer)
SELECT doc_type, doc_type IN (SELECT c_mktsegment FROM customer) AS found FROM w
""")
def type_exists(spark, sf):
    docs = table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "doc_type")
    wanted = (
        table(spark, sf, "region")
        .select(F.col("r_name").alias("doc_type"))
        .union(docs.select("doc_type"))
        .distinct()
    )
    return S.types_exist(wanted, docs)


@register("""
SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total
FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50 OFFSET 100
""")
def paged(spark, sf):
    return S.page(
        table(spark, sf, "orders"), term("o_orderstatus", "F"), 100, 50, "o_orderkey"
    ).select("o_orderkey", "o_totalprice", "total")


@register("""
WITH h AS (SELECT o_orderkey, o_totalprice, count(*) OVER () AS total, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i,
                  row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders WHERE o_orderstatus = 'F')
SELECT 'offset' AS way, o_orderkey, o_totalprice, total FROM h WHERE i BETWEEN 0 AND 9 OR i BETWEEN total // 2 AND total // 2 + 29 OR i >= total - 5
UNION ALL SELECT 'key', o_orderkey, o_totalprice, total FROM h WHERE k < 60
""")
def deep_pages(spark, sf):
    """Pages far down a result: by offset through known ranges, and by the last key of the page before."""
    orders, found = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), term("o_orderstatus", "F")
    index = S.PageIndex(orders, found, ["o_totalprice", "o_orderkey"])
    pages = [index.page(0, 10), index.page(index.total // 2, 30), index.page(max(0, index.total - 5), 30), index.page(index.total + 100, 10)]
    out, after = [p.select(F.lit("offset").alias("way"), "o_orderkey", "o_totalprice", "total") for p in pages], None
    for _ in range(3):
        page = S.page_after(orders, found, after, 20, "o_orderkey")
        after = page.agg(F.max("o_orderkey")).first()[0]
        out.append(page.select(F.lit("key").alias("way"), "o_orderkey", "o_totalprice", F.lit(index.total).alias("total")))
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    return both


@register("""
SELECT source, count(*) AS n FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY source
""")
def unlabelled_by_source(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    hits = S.query(joined, must_not(exists("quality")))
    return hits.groupBy("source").agg(F.count("*").alias("n"))
