"""Registered queries: each operator over its whole table, with the SQL of those that SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat, decontaminate, jaccard, language_model, manifest, negatives, pieces, quality, repeats, shards, token_files, vector_join, warc,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(4) != 2)
    held_out = F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_cosine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_join.cosine_links(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.lm_scores(table(spark, sf_dir, "documents"), remainder(10) != 0)
    return scored.select(
        F.col("doc").alias("doc_id"), (~F.col("train")).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_digest(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    return chat.chat_digest(turns.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encoded(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return found.select(F.col("doc").alias("doc_id"), "n_pieces", "ids_crc32", "exact", "ids")


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_digest(table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest_digest(table(spark, sf_dir, "documents"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shards_digest(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.negatives_digest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_cosine_join, op3_lm_scores, op4_repeats, op5_chat_format, op6_sentencepiece,
        op7_warc_derivatives, op8_jaccard_join, op9_token_files, op10_decontaminate,
        op11_manifest, op12_shards, op13_hard_negatives,
    )
}

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
REACH = """reach AS (
  SELECT id, id AS r FROM nodes
  UNION
  SELECT e.b AS id, reach.r FROM reach JOIN edges e ON e.a = reach.id WHERE reach.r < e.b)"""

SQL: dict[str, str] = {
    "op2_cosine_join": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
edges AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings), {REACH},
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
k AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN k ON k.a = vec_id""",
    "op4_repeats": f"""
WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS s, w FROM d WHERE len(w) >= 35),
g AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + 34], ' ')) AS h FROM p),
m AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, s + unnest(range(0, 35)) AS i FROM g SEMI JOIN m USING (h)),
r AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
k AS (SELECT doc_id, w, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept
      FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k""",
    "op8_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER.format('text'))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS z FROM d),
t AS (SELECT doc_id, unnest(z) AS g FROM s),
n AS (SELECT doc_id, len(z)::BIGINT AS n FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
edges AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
nodes AS (SELECT doc_id AS id FROM documents), {REACH},
q AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN q ON q.id = doc_id""",
    "op10_decontaminate": f"""
WITH i AS (SELECT item_id, {ALNUM.format('text')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {ALNUM.format('text')} AS w FROM documents),
dw AS (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS g
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
h AS (SELECT doc_id, s, m, item_id FROM dw JOIN iw USING (m, g)),
c AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, s + unnest(range(0, m)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op5_chat_format": r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g') AS safe FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(safe) + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
}

#: Table of the CRC-32 polynomial.
CRC_TABLE = """
crc_step(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END, k + 1 FROM crc_step WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8)"""


def crc32_sql(data: str) -> str:
    """CRC-32 of a list of byte values, with the table ``t`` in scope."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda acc, b: xor(acc // 256, t[(xor(acc % 256, b) + 1)::INT])), 4294967295::BIGINT)"


def manifest_sql(levels: int = 6, tops: int = 3) -> str:
    """SQL of the manifest for at most 8**levels rows of a ``lang`` and 8**tops values of it.

    Level k of a tree has the digests of level k - 1 in runs of eight; ``size`` is its number of nodes. A
    level above a tree's top repeats the top.
    """

    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    def tree(first: str, name: str, count: int) -> list[str]:
        out, below = [], first
        for k in range(1, count + 1):
            out.append(f"""{name}{k} AS MATERIALIZED (SELECT g, pos // 8 AS pos, list(h ORDER BY pos) AS kids, any_value(n) AS below,
  CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h, (any_value(n) + 7) // 8 AS n
  FROM {below} GROUP BY g, pos // 8)""")
            below = f"{name}{k}"
        return out

    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = LOWER.format("text").replace("coalesce(text, '')", "text")
    bytes_of = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)"
    parts = [
        CRC_TABLE.strip(),
        f"""l AS (SELECT doc_id, lang AS g, sha256({head} || {field('text')}) AS leaf, sha256({head} || {field(lower)}) AS low,
  coalesce({crc32_sql(bytes_of)} % 3 = 0, false) AS hit FROM documents, crc_table)""",
        """a0 AS MATERIALIZED (SELECT doc_id, g, leaf AS h, CASE WHEN hit THEN low ELSE leaf END AS shown,
  row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l)""",
        *tree("a0", "a", levels),
        f"""b0 AS MATERIALIZED (SELECT 0 AS g, g AS lang, h, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS pos,
  count(*) OVER () AS n FROM a{levels})""",
        *tree("b0", "b", tops),
    ]
    joins, steps = [], []
    for k in range(1, levels + 1):
        joins.append(f"JOIN a{k} ON a{k}.g IS NOT DISTINCT FROM a0.g AND a{k}.pos = a0.pos // {8**k}")
        steps.append((f"a{k}", f"(a0.pos // {8 ** (k - 1)} % 8)::INT"))
    joins.append("JOIN b0 ON b0.lang IS NOT DISTINCT FROM a0.g")
    for k in range(1, tops + 1):
        joins.append(f"JOIN b{k} ON b{k}.pos = b0.pos // {8**k}")
        steps.append((f"b{k}", f"(b0.pos // {8 ** (k - 1)} % 8)::INT"))
    path = ", ".join(f"CASE WHEN {t}.below > 1 THEN {{'i': {i}, 'k': {t}.kids}} END" for t, i in steps)
    parts.append(f"""p AS (SELECT a0.doc_id, a0.h AS leaf, a0.shown, b0.h AS subroot, b{tops}.h AS root,
  list_filter([{path}], lambda s: s IS NOT NULL) AS path FROM a0 {' '.join(joins)})""")
    parts.append("""f AS (SELECT *, sha256(array_to_string(flatten(list_transform(path, lambda s: s.k[:s.i] || s.k[s.i + 2:])), '')) AS proof_sha256,
  list_reduce(list_prepend({'i': 0, 'k': [shown]}, path),
    lambda acc, s: {'i': 0, 'k': [sha256(array_to_string(s.k[:s.i] || acc.k || s.k[s.i + 2:], ''))]}).k[1] AS folded_root FROM p)""")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\nSELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f"


SQL["op11_manifest"] = manifest_sql()
SQL["op12_shards"] = f"""
WITH RECURSIVE {CRC_TABLE.strip()},
s AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 16 AS size,
        {crc32_sql("list_transform(range(0, strlen(coalesce(text, ''))), lambda i: ('0x' || substring(hex(encode(coalesce(text, ''))), (2 * i + 1)::BIGINT, 2))::BIGINT)")} AS text_crc32
      FROM documents, crc_table),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY
        md5('mixture:' || coalesce(doc_id::VARCHAR, '-') || ':' || text_crc32 || ':' || size), doc_id NULLS FIRST) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (pos * 40 // total)::INT AS shard,
  pos - ((pos * 40 // total) * total + 39) // 40 AS slot, NULL::INT AS grown_shard, source FROM p"""
SQL["op13_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike,
    list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS s
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b)::INT AS rank,
  n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.alike AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) <= 10"""
