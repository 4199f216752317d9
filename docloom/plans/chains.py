"""Processing chains, spans and user steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import iso_text, lenient_timestamp
from ..operators import chain as P, spans as E
from ..operators.sentiment import sentiment_step
from ..sources import artifacts as files
from ..session import spread
from .registry import register, table


@register("""
WITH d AS (SELECT doc_id, lang AS doc_type, source, text, n_chars FROM documents WHERE NOT (lang = 'en' AND n_chars < 300))
SELECT doc_id, doc_type,
  CASE WHEN doc_type = 'en' AND length(text) > 0 THEN left(text, 40) WHEN doc_type = 'de' THEN 'kept' ELSE 'none' END AS preview,
  CASE WHEN doc_type IN ('fr', 'en') THEN 'bar' ELSE 'none' END AS foo,
  CASE doc_type WHEN 'en' THEN 'ContentPreview,DropShort,Foo' WHEN 'fr' THEN 'Foo' WHEN 'de' THEN 'Broken!,After' ELSE '' END AS steps
FROM d
""")
def chain_run(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("doc_type"), "source", "text", "n_chars"
    )
    foo = P.Step("Foo", P.constant_field, {"target": "foo", "value": "bar"})

    def broken(df, p):
        return P.Outcome(
            {"preview": F.lit("lost")}, error=F.col("n_chars") >= 0, message=F.lit("no model")
        )

    def after(df, p):
        return P.Outcome({"preview": F.lit("kept")})

    chains = {
        "en": [
            P.Step("ContentPreview", P.content_preview, {"source": "text", "target": "preview", "size": 40}),
            P.Step("DropShort", P.drop_where(lambda df: F.col("n_chars") < 300)),
            foo,
        ],
        "fr": [foo],
        "de": [P.Step("Broken", broken), P.Step("After", after)],
    }
    out = P.run_chain(docs, chains, audit="_steps")
    steps = F.transform(
        "_steps", lambda s: F.concat(s["step_name"], F.when(s["error"], "!").otherwise(""))
    )
    return out.select(
        "doc_id",
        "doc_type",
        F.coalesce("preview", F.lit("none")).alias("preview"),
        F.coalesce("foo", F.lit("none")).alias("foo"),
        F.array_join(steps, ",").alias("steps"),
    )


@register("""
SELECT conv_id, turn, left(text, CASE WHEN role = 'user' THEN 5 WHEN role = 'assistant' THEN 7 ELSE 12 END) AS preview
FROM conversations
""")
def parameter_override(spark, sf):
    own = F.when(F.col("role") == "user", F.lit('{"ContentPreview":{"size":5}}')).when(
        F.col("role") == "assistant", F.lit('{"ContentPreview.size":7}')
    )
    docs = table(spark, sf, "conversations").select(
        "conv_id", "turn", "text", F.lit("Turn").alias("doc_type"), F.parse_json(own).alias("parameters")
    )
    step = P.Step("ContentPreview", P.content_preview, {"source": "text", "target": "preview", "size": 12})
    return P.run_chain(docs, {"Turn": [step]}).select("conv_id", "turn", "preview")


@register("""
SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 'none' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS day
FROM orders
""")
def normalised_dates(spark, sf):
    day, priority = F.col("o_orderdate"), F.col("o_orderpriority")
    text = (
        F.when(priority == "1-URGENT", F.date_format(day, "dd|MM|yyyy"))
        .when(priority == "2-HIGH", F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(priority == "3-MEDIUM", F.date_format(day, "dd MMM yyyy"))
        .when(priority == "5-LOW", F.lit("some time ago"))
        .otherwise(F.concat(F.lit("ordered on "), F.date_format(day, "yyyy-MM-dd"), F.lit(" or so")))
    )
    docs = table(spark, sf, "orders").select("o_orderkey", F.lit("Order").alias("doc_type"), text.alias("raw"))
    step = P.Step(
        "DateNormalizer",
        P.date_normalizer,
        {"source": "raw", "target": "day", "date_formats": ["%d|%m|%Y"], "fuzzy": True},
    )
    out = P.run_chain(docs, {"Order": [step]})
    return out.select("o_orderkey", F.coalesce(iso_text(F.col("day")), F.lit("none")).alias("day"))


@register("""
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 13 <> 0 THEN 'bar ' || lower(c_name) ELSE 'none' END AS foo, c_name,
       CASE WHEN c_mktsegment <> 'BUILDING' THEN 'not run' WHEN c_custkey % 13 = 0 THEN 'KeyError: ' || c_custkey ELSE 'ok' END AS outcome
FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_custkey % 13 <> 0 AND c_custkey % 17 = 0)
""")
def user_step(spark, sf):
    """A document function that drops some documents and fails for others."""
    docs = spread(table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("doc_type"))).withColumn("foo", F.lit("none"))

    def named(parameters, doc):
        if doc["c_custkey"] % 13 == 0:
            raise KeyError(doc["c_custkey"])
        return None if doc["c_custkey"] % 17 == 0 else {"foo": f"{parameters['word']} {doc['c_name'].lower()}"}

    out = P.user_step(docs, "BUILDING", P.each_document(named), ["c_custkey", "c_name"], {"foo": "string"}, parameters={"word": "bar"})
    ran = F.get("_pipeline", F.lit(0))
    outcome = F.when(ran.isNull(), "not run").when(ran["error"], last_line(ran["message"])).otherwise("ok")
    return out.select("c_custkey", "foo", "c_name", outcome.alias("outcome"))


def last_line(message):
    """The last line of a traceback."""
    return F.regexp_extract(message, r"([^\n]+)\s*$", 1)


@register("""
WITH d AS (SELECT doc_id, lang AS doc_type, CASE WHEN doc_id % 3 = 0 THEN n_chars || ' letters' WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars::VARCHAR END AS raw
           FROM documents WHERE NOT (lang = 'en' AND doc_id % 11 = 0 AND doc_id % 7 <> 0))
SELECT doc_id, CASE WHEN doc_type = 'en' AND doc_id % 3 <> 0 THEN raw::BIGINT END AS size,
  CASE WHEN doc_type <> 'en' THEN NULL WHEN doc_id % 7 = 0 OR doc_id % 3 = 0 OR raw IS NULL THEN 'unread' ELSE 'about ' || (raw::BIGINT // 100) END AS word,
  doc_type = 'en' AS done,
  CASE WHEN doc_type <> 'en' THEN '' ELSE
    'Size' || CASE WHEN doc_id % 3 = 0 THEN '!cannot cast ''' || raw || ''' to bigint' ELSE '' END || ';Word' ||
    CASE WHEN doc_id % 7 = 0 THEN '!ValueError: seventh ' || doc_id ELSE '' END || ';Done' END AS audit
FROM d
""")
def chain_errors(spark, sf):
    """A chain in which a cast fails for some documents and a Python step raises for others; the audit tells both."""
    n, key = F.col("n_chars").cast("string"), F.col("doc_id")
    raw = F.when(key % 3 == 0, F.concat(n, F.lit(" letters"))).when(key % 5 != 0, n)
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("doc_type"), raw.alias("raw"))

    def word(frame, parameters):
        frame["word"] = parameters["unread"]
        bad = frame["doc_id"][frame["doc_id"] % 7 == 0]
        if len(bad):
            raise ValueError(f"seventh {bad.iloc[0]}")
        known = frame["size"].notna()
        frame.loc[known, "word"] = "about " + (frame.loc[known, "size"].astype("int64") // 100).astype(str)
        return frame[frame["doc_id"] % 11 != 0]

    steps = [
        P.Step("Size", P.cast_field, {"source": "raw", "target": "size", "type": "bigint"}),
        P.PythonStep("Word", word, ["doc_id", "size"], {"word": "string"}, {"unread": "unread"}),
        P.Step("Done", P.constant_field, {"target": "done", "value": True}),
    ]
    out = P.run_chain(docs, {"en": steps}, audit="steps")
    failed = lambda s: F.when(s["error"], F.concat(F.lit("!"), last_line(s["message"]))).otherwise("")
    told = F.transform("steps", lambda s: F.concat(s["step_name"], failed(s)))
    return out.select("doc_id", "size", "word", F.coalesce("done", F.lit(False)).alias("done"), F.array_join(told, ";").alias("audit"))


# the month names of two languages, first in both dialects of SQL
FRENCH = "'janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre'"
GERMAN = "'Januar','Februar','März','April','Mai','Juni','Juli','August','September','Oktober','November','Dezember'"
# a text with a date: for DuckDB, for Spark, and what is to be found in it
DATE_FORMS = [
    (
        "'Shipped on ' || monthname(t) || ' ' || day(t) || ', ' || year(t) || ' at ' || strftime(t, '%I:%M:%S %p') || ' from Hamburg'",
        "'Shipped on ' || date_format(t, 'MMMM') || ' ' || day(t) || ', ' || year(t) || ' at ' || date_format(t, 'hh:mm:ss a') || ' from Hamburg'",
        "t",
    ),
    (
        f"'livré le ' || day(t) || ' ' || [{FRENCH}][month(t)] || ' ' || year(t) || ' à ' || strftime(t, '%H:%M') || ' !'",
        f"'livré le ' || day(t) || ' ' || array({FRENCH})[month(t) - 1] || ' ' || year(t) || ' à ' || date_format(t, 'HH:mm') || ' !'",
        "date_trunc('minute', t)",
    ),
    (
        "'seen at ' || strftime(t, '%Y-%m-%dT%H:%M:%S') || '+0530, then closed'",
        "'seen at ' || date_format(t, \"yyyy-MM-dd'T'HH:mm:ss\") || '+0530, then closed'",
        "t - INTERVAL 330 MINUTE",
    ),
    (
        "day(t) || 'th of ' || monthname(t) || ' ' || year(t) || ' ' || strftime(t, '%H:%M:%S') || ' GMT'",
        "day(t) || 'th of ' || date_format(t, 'MMMM') || ' ' || year(t) || ' ' || date_format(t, 'HH:mm:ss') || ' GMT'",
        "t",
    ),
    (
        "strftime(t, '%m/%d/%Y %I:%M:%S') || CASE WHEN hour(t) >= 12 THEN ' p.m.' ELSE ' a.m.' END",
        "date_format(t, 'MM/dd/yyyy hh:mm:ss') || CASE WHEN hour(t) >= 12 THEN ' p.m.' ELSE ' a.m.' END",
        "t",
    ),
    ("'log ' || strftime(t, '%Y%m%dT%H%M%S') || ' end'", "'log ' || date_format(t, \"yyyyMMdd'T'HHmmss\") || ' end'", "t"),
    (
        f"strftime(t, '%d. ') || [{GERMAN}][month(t)] || strftime(t, ' %Y, %H:%M:%S') || ' Uhr'",
        f"date_format(t, 'dd. ') || array({GERMAN})[month(t) - 1] || date_format(t, ' yyyy, HH:mm:ss') || ' Uhr'",
        "t",
    ),
    ("strftime(t, '%a %b %d %H:%M:%S %Y')", "date_format(t, 'EEE MMM dd HH:mm:ss yyyy')", "t"),
    ("'some time ago'", "'some time ago'", "NULL"),
    (
        "'about ' || (1 + k % 40) || ' days ago'",
        "'about ' || (1 + k % 40) || ' days ago'",
        "TIMESTAMP '2024-01-10 12:30:00' - to_days((1 + k % 40)::INT)",
    ),
    ("'due in three weeks'", "'due in three weeks'", "TIMESTAMP '2024-01-31 12:30:00'"),
    (
        "'between ' || strftime(t, '%d.%m.%y') || ' and later'",
        "'between ' || date_format(t, 'dd.MM.yy') || ' and later'",
        "CASE WHEN day(t) > 12 THEN date_trunc('day', t) ELSE make_timestamp(year(t), day(t), month(t), 0, 0, 0) END",
    ),
]


def forms_sql(which: int) -> str:
    return f"CASE k % {len(DATE_FORMS)} {' '.join(f'WHEN {i} THEN {form[which]}' for i, form in enumerate(DATE_FORMS))} END"


@register(f"""
WITH o AS (SELECT o_orderkey AS k, o_orderdate::TIMESTAMP + to_seconds((o_orderkey * 7919 % 86400)::BIGINT) AS t FROM orders)
SELECT k AS o_orderkey, {forms_sql(0)} AS raw, coalesce(strftime(({forms_sql(2)})::TIMESTAMP, '%Y-%m-%dT%H:%M:%S'), 'none') AS day FROM o
""")
def fuzzy_dates(spark, sf):
    """Dates with times of day inside sentences of four languages, zones, relative phrases and bare numbers."""
    key = F.col("o_orderkey")
    moment = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + key * 7919 % 86400)
    docs = table(spark, sf, "orders").select(key.alias("k"), moment.alias("t"))
    docs = docs.select("k", F.expr(forms_sql(1)).alias("raw"), F.lit("Order").alias("doc_type"))
    step = P.Step("DateNormalizer", P.date_normalizer, {"source": "raw", "target": "day", "now": "2024-01-10 12:30:00"})
    out = P.run_chain(docs, {"Order": [step]})
    return out.select(F.col("k").alias("o_orderkey"), "raw", F.coalesce(iso_text(F.col("day")), F.lit("none")).alias("day"))


# Labelled patterns for text references.
PATTERNS = [
    ("EMAIL", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"),
    ("URL", r"https?://[^\s<>]+"),
    ("NUMBER", r"[0-9]+"),
]

@register(
    " UNION ALL ".join(
        """
SELECT doc_id, '{label}' AS label, CAST(stop - length(found) AS INTEGER) AS start_char, CAST(stop AS INTEGER) AS end_char, found AS text
FROM (SELECT doc_id, found, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
      FROM (SELECT doc_id, unnest(range(len(gaps))) AS i, unnest(gaps) AS gap, unnest(founds) AS found
            FROM (SELECT doc_id, string_split_regex(text, '{rx}') AS gaps,
                         list_append(regexp_extract_all(text, '{rx}'), '') AS founds FROM documents)))
WHERE found <> ''""".format(label=label, rx=rx)
        for label, rx in PATTERNS
    )
)
def entity_spans(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return E.pattern_spans(docs, "doc_id", "text", PATTERNS).select(
        "doc_id", "label", "start_char", "end_char", "text"
    )


@register(r"""
WITH terms AS (
  SELECT DISTINCT lower(w) AS term, CASE WHEN length(w) > 6 THEN 'LONG' ELSE 'SHORT' END AS label
  FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM benchmark)),
spans AS (
  SELECT doc_id, found, stop - length(found) AS start_char, stop AS end_char
  FROM (SELECT doc_id, found, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
        FROM (SELECT doc_id, unnest(range(len(gaps))) AS i, unnest(gaps) AS gap, unnest(founds) AS found
              FROM (SELECT doc_id, string_split_regex(text, '\p{L}+') AS gaps,
                           list_append(regexp_extract_all(text, '\p{L}+'), '') AS founds FROM documents)))
  WHERE found <> '')
SELECT doc_id, label, count(*) AS n, CAST(sum(start_char) AS BIGINT) AS starts, CAST(sum(end_char) AS BIGINT) AS ends
FROM spans JOIN terms ON lower(found) = term GROUP BY doc_id, label
""")
def gazetteer_spans(spark, sf):
    word = F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w")
    terms = table(spark, sf, "benchmark").select(word).select(
        F.lower("w").alias("term"), F.when(F.length("w") > 6, "LONG").otherwise("SHORT").alias("label")
    )
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    found = E.gazetteer_spans(docs, "doc_id", "text", terms)
    return found.groupBy("doc_id", "label").agg(
        F.count("*").alias("n"),
        F.sum(F.col("start_char").cast("long")).alias("starts"),
        F.sum(F.col("end_char").cast("long")).alias("ends"),
    )


@register(r"""
WITH lex AS (SELECT * FROM (VALUES ('the', 0.25, 0.5), ('ich', -0.5, 0.25), ('les', 0.75, 1.0), ('hablees', 1.0, 0.0)) t(w, p, s)),
tok AS (SELECT conv_id, turn, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}_]+'),
          lambda t: length(t) BETWEEN 2 AND 15 AND t[1] <> '_')) AS w FROM conversations)
SELECT c.conv_id, c.turn, round(coalesce(avg(p), 0), 6) AS polarity, round(coalesce(avg(s), 0), 6) AS subjectivity
FROM conversations c LEFT JOIN (SELECT tok.conv_id, tok.turn, CAST(p AS DOUBLE) AS p, CAST(s AS DOUBLE) AS s FROM tok JOIN lex USING (w)) h
  ON h.conv_id = c.conv_id AND h.turn = c.turn
GROUP BY c.conv_id, c.turn
""")
def streaming_sentiment(spark, sf):
    lexicon = {"the": (0.25, 0.5), "ich": (-0.5, 0.25), "les": (0.75, 1.0), "hablees": (1.0, 0.0)}
    docs = table(spark, sf, "conversations").withColumn("doc_type", F.lit("Turn"))
    step = P.Step("StreamingSentiment", sentiment_step(lexicon), {"source": "text", "target": "mood"})
    return P.run_chain(docs, {"Turn": [step]}).select(
        "conv_id",
        "turn",
        F.round("mood.polarity", 6).alias("polarity"),
        F.round("mood.subjectivity", 6).alias("subjectivity"),
    )


@register("""
SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'none'
  ELSE sha256(text) END AS digest FROM documents
""")
def artifact_text(spark, sf):
    """One text file per document in two charsets; two sources have a second or an odd file."""
    docs = table(spark, sf, "documents")
    stored = docs.select(
        F.lit("Doc").alias("doc_type"),
        F.col("doc_id").cast("string").alias("id"),
        F.explode(
            F.when(F.col("source") == "src1", F.array(F.lit("a.txt"), F.lit("b.txt")))
            .when(F.col("source") == "src2", F.array(F.lit("picture.png")))
            .otherwise(F.array(F.lit("Body.TXT")))
        ).alias("filename"),
        F.encode("text", "UTF-8").alias("content"),
    )
    empty = docs.select(F.lit("Doc").alias("doc_type"), F.col("doc_id").cast("string").alias("id"), "doc_id")
    out = files.extract_text(empty, stored, "content", extensions=[".txt"])
    return out.select("doc_id", F.coalesce(F.sha2("content", 256), F.lit("none")).alias("digest"))


@register("""
SELECT doc_id, CASE WHEN strftime(DATE '2020-01-01' + INTERVAL (n_chars) DAY, '%Y') > '2022' THEN 'late' ELSE 'early' END AS era
FROM documents
""")
def lenient_dates(spark, sf):
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("n_chars").cast("int"))
    text = F.when(F.col("lang") == "en", F.date_format(day, "yyyy/MM/dd")).otherwise(
        F.date_format(day, "MMMM d, yyyy")
    )
    parsed = lenient_timestamp(text, fuzzy=False)
    return table(spark, sf, "documents").select(
        "doc_id", F.when(F.year(parsed) > 2022, "late").otherwise("early").alias("era")
    )
