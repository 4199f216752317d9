"""Bucket and metric aggregations, run records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import term
from ..operators import aggregates as G, articles as A, runs as R
from ..session import fresh_dir
from .registry import register, table


@register("""
SELECT event_type AS doc_type, count(*) AS n_docs FROM events GROUP BY event_type
UNION ALL SELECT 'document-' || lang, count(*) FROM documents GROUP BY lang
UNION ALL SELECT 'page', count(*) FROM pages
""")
def document_counts(spark, sf):
    kinds = (
        table(spark, sf, "events")
        .select(F.col("event_type").alias("doc_type"))
        .unionAll(table(spark, sf, "documents").select(F.concat(F.lit("document-"), "lang")))
        .unionAll(table(spark, sf, "pages").select(F.lit("page")))
    )
    return G.document_counts(kinds)


@register("""
SELECT source AS term, count(*) AS n_docs FROM documents WHERE lang = 'en' GROUP BY source
ORDER BY n_docs DESC, term LIMIT 10000
""")
def term_counts(spark, sf):
    return G.term_counts(table(spark, sf, "documents"), "source", term("lang", "en"))


@register(r"""
WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"#]+)', 1))) AS term FROM pages)
SELECT term, count(*) AS n_docs FROM l GROUP BY term ORDER BY n_docs DESC, term LIMIT 10000
""")
def term_counts_array(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.regexp_extract_all("html", F.lit('href="([^"#]+)'), F.lit(1)).alias("links")
    )
    return G.term_counts(pages, "links")


@register("""
SELECT CAST(min(value) AS DOUBLE) AS min_value, CAST(max(value) AS DOUBLE) AS max_value
FROM events WHERE event_type = 'purchase'
""")
def min_max(spark, sf):
    return G.extremes(table(spark, sf, "events"), "value", term("event_type", "purchase"))


@register("""
SELECT strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events
""")
def ts_range(spark, sf):
    return G.time_range(table(spark, sf, "events"), "ts")


@register("""
SELECT count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total,
       round(avg(value), 6) AS mean, max(value) AS top
FROM events WHERE event_type = 'click'
""")
def named_aggs(spark, sf):
    return G.metrics(
        table(spark, sf, "events"),
        {
            "n": F.count("*"),
            "users": F.count_distinct("user_id"),
            "total": F.round(F.sum("value"), 4),
            "mean": F.round(F.avg("value"), 6),
            "top": F.max("value"),
        },
        term("event_type", "click"),
    )


RUNS_SQL = """
WITH log AS (
  SELECT 'job-' || (user_id % 7) AS analytic_name,
         user_id || '-' || strftime(ts, '%Y%m%d') AS analytic_session_id,
         CASE WHEN event_type = 'purchase' THEN true WHEN event_type = 'signup' THEN false END AS finished,
         CASE WHEN event_type = 'error' THEN true WHEN event_type = 'signup' THEN false END AS error,
         event_type AS message, value, event_id
  FROM events),
runs AS (
  SELECT analytic_name, analytic_session_id, arg_max(ROW(finished, error, message, value), event_id) AS s
  FROM log GROUP BY ALL),
r AS (
  SELECT analytic_name, analytic_session_id, coalesce(s[1], false) AS finished,
         coalesce(s[2], false) AS error, s[3] AS message, s[4] AS value
  FROM runs)
"""


def run_log(spark, sf):
    """Status reports of runs: one run per user and day, flags missing on most reports."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.concat(F.lit("job-"), F.col("user_id") % 7).alias("analytic_name"),
        F.concat("user_id", F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias(
            "analytic_session_id"
        ),
        F.when(kind == "purchase", True).when(kind == "signup", False).alias("finished"),
        F.when(kind == "error", True).when(kind == "signup", False).alias("error"),
        kind.alias("message"),
        "value",
        "event_id",
    )


def current_runs(spark, sf):
    return R.latest_status(
        run_log(spark, sf), F.col("event_id"), ["finished", "error", "message", "value"]
    )


@register(RUNS_SQL + "SELECT * FROM r")
def run_status(spark, sf):
    return current_runs(spark, sf).fillna({"finished": False, "error": False})


@register(RUNS_SQL + "SELECT analytic_name, count(*) AS n_runs FROM r GROUP BY analytic_name")
def run_counts(spark, sf):
    return R.run_counts(current_runs(spark, sf))


@register(
    RUNS_SQL
    + "SELECT analytic_name, count(*) AS n_runs FROM r WHERE NOT finished AND NOT error GROUP BY ALL"
)
def active_counts(spark, sf):
    return R.run_counts(R.active(current_runs(spark, sf)))


@register(
    RUNS_SQL
    + """
SELECT 'active' AS state, analytic_name, analytic_session_id FROM r WHERE NOT finished AND NOT error
UNION ALL SELECT 'error', analytic_name, analytic_session_id FROM r WHERE error
UNION ALL SELECT 'finished', analytic_name, analytic_session_id FROM r WHERE finished
"""
)
def sessions_by_state(spark, sf):
    runs = current_runs(spark, sf)
    out = None
    for state in ("active", "error", "finished"):
        one = R.sessions(runs, state).select(F.lit(state).alias("state"), *R.RUN_KEY)
        out = one if out is None else out.unionAll(one)
    return out


@register(
    RUNS_SQL
    + "SELECT analytic_name, count(*) AS n_runs FROM r WHERE analytic_name <> 'job-3' GROUP BY ALL"
)
def delete_runs(spark, sf):
    return R.run_counts(R.without_runs(current_runs(spark, sf), "job-3"))


@register(
    RUNS_SQL
    + """, one AS (SELECT min(analytic_session_id) AS s FROM r WHERE analytic_name = 'job-3')
SELECT 'one run' AS form, count(*) AS n_runs FROM r, one WHERE NOT (analytic_name = 'job-3' AND analytic_session_id = s)
UNION ALL SELECT 'one session of any analytic', count(*) FROM r, one WHERE analytic_session_id <> s
UNION ALL SELECT 'all runs', 0"""
)
def delete_run_forms(spark, sf):
    runs = current_runs(spark, sf)
    session = runs.where("analytic_name = 'job-3'").agg(F.min("analytic_session_id")).first()[0]
    forms = {"one run": ("job-3", session), "one session of any analytic": (None, session), "all runs": (None, None)}
    left = [R.without_runs(runs, *chosen).agg(F.lit(form).alias("form"), F.count("*").alias("n_runs")) for form, chosen in forms.items()]
    return left[0].unionByName(left[1]).unionByName(left[2])


@register(r"""
SELECT regexp_extract(html, '(?i)<html[^>]*\slang=["'']?([A-Za-z]{2})', 1) AS meta_lang,
       count(*) AS n, max(length(html)) AS longest
FROM pages GROUP BY 1
""")
def page_languages(spark, sf):
    return (
        table(spark, sf, "pages")
        .groupBy(F.coalesce(A.page_language(F.col("html")), F.lit("")).alias("meta_lang"))
        .agg(F.count("*").alias("n"), F.max(F.length("html")).alias("longest"))
    )


@register("""
WITH n AS (SELECT lang, count(*) AS n FROM documents WHERE lang IN ('de', 'en') GROUP BY lang)
SELECT 'by_language' AS analytic_name, lang AS session, false AS error, n AS n_out, 'all' AS parent, '' AS message FROM n
UNION ALL SELECT 'by_language', 'bad', true, NULL, 'all', 'lang: type'
UNION ALL SELECT 'broken', 'broken', true, NULL, '', 'no ' || (SELECT count(*) FROM documents)
UNION ALL SELECT 'all', 'all', false, sum(n)::BIGINT, '', '' FROM n
""")
def job_runs(spark, sf):
    """Jobs with checked parameters, run by a parent job, as their run log tells them: finished, refused and broken ones."""
    log, out = fresh_dir(spark, "run-log"), fresh_dir(spark, "run-out")
    schema = {"properties": {"lang": {"type": "string"}}, "required": ["lang"]}

    def one(session, lang):
        job = lambda spark, p: table(spark, sf, "documents").where(F.col("lang") == p["lang"])
        return R.run_job(spark, log, "by_language", session, job, {"lang": lang}, schema, f"{out}/{session}", parent="all")

    def every(spark, parameters):
        return one("de", "de").unionByName(one("en", "en"))

    def broken(spark, parameters):
        raise RuntimeError(f"no {table(spark, sf, 'documents').count()}")

    R.run_job(spark, log, "all", "all", every, {}, out_path=f"{out}/all")
    for attempt in (lambda: one("bad", 3), lambda: R.run_job(spark, log, "broken", "broken", broken, {})):
        try:
            attempt()
        except (ValueError, RuntimeError):
            continue
        raise AssertionError("a wrong run has passed")
    rows = spark.read.parquet(log).where("finished")
    return rows.select(
        "analytic_name", F.col("analytic_session_id").alias("session"), "error", "n_out", F.coalesce("parent", F.lit("")).alias("parent"),
        F.coalesce("message", F.lit("")).alias("message"),
    )
