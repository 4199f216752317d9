"""Document store on plain Parquet: an append-only change log and its folded view.

Layout below ``root/tenant``::

    log/batch=<n>/run=<r>/outcome=<stored|error kind>/type_key=<lower-case type>/*.parquet
    families/batch=<n>/run=<r>/*.parquet      field families first seen in batch n
    snapshots/<n>/type_key=.../       folded state up to batch n
    commits/*.parquet                 one row per finished batch, drop or snapshot

A batch is numbered after the newest one, and its folder also bears a random number of its run: two writers
that draw the same number both keep their rows. It is written by one Spark job and becomes visible with its commit row, so a failed or
replayed job leaves nothing behind that readers see. Readers open only the directories of live
batches after the newest snapshot; types and outcomes prune by partition. Types that differ only
in case share a collection.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.predicates import Clause
from .operators import ingest, rules
from .operators.merge import fold_documents
from .session import even, written

LOG = (
    "doc_type string, id string, seq struct<batch:bigint,run:bigint,pos:bigint>, op string, ts timestamp, "
    "body variant, message string, batch long, run long, outcome string, type_key string"
)
COMMITS = "batch long, run long, kind string, type_key string, writer string, epoch long"
FAMILIES = "doc_type string, path string, family string, batch long, run long"


class DocumentStore:
    def __init__(self, spark: SparkSession, root: str, tenant: str = "default"):
        self.spark = spark
        self.root = f"{root.rstrip('/')}/{tenant}"

    # -- commits: metadata, one row per batch ----------------------------------------------

    def _commits(self) -> list:
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits").collect()
        except AnalysisException:
            return []

    def batch_of(self, writer: str, epoch: int) -> int | None:
        """The batch that a stream's micro-batch was stored as, if it was."""
        try:
            commits = self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits")
            mine = commits.filter((F.col("writer") == writer) & (F.col("epoch") == epoch))
            return mine.agg(F.max("batch")).first()[0]
        except AnalysisException:
            return None

    def _commit(
        self, batch: int, kind: str, type_key: str | None = None, source: tuple[str, int] | None = None, run: int = 0
    ) -> None:
        row = self.spark.range(1).select(
            F.lit(batch).cast("long").alias("batch"),
            F.lit(run).cast("long").alias("run"),
            F.lit(kind).alias("kind"),
            F.lit(type_key).cast("string").alias("type_key"),
            F.lit(source[0] if source else None).cast("string").alias("writer"),
            F.lit(source[1] if source else None).cast("long").alias("epoch"),
        )
        row.write.mode("append").parquet(f"{self.root}/commits")

    @staticmethod
    def _dropped(commits: list) -> dict[str, int]:
        """Newest drop of each collection that was ever dropped."""
        newest: dict[str, int] = {}
        for c in commits:
            if c["kind"] == "drop":
                newest[c["type_key"]] = max(c["batch"], newest.get(c["type_key"], 0))
        return newest

    @staticmethod
    def _new_run() -> int:
        return uuid.uuid4().int >> 65

    def _next_batch(self) -> int:
        return max((c["batch"] for c in self._commits()), default=0) + 1

    # -- reading ---------------------------------------------------------------------------

    def changes(self, after: int = 0, commits: list | None = None) -> DataFrame:
        """Rows of all finished batches newer than ``after``, stored and rejected."""
        commits = self._commits() if commits is None else commits
        live = sorted({(c["batch"], c["run"]) for c in commits if c["kind"] == "log"})
        paths = [f"{self.root}/log/batch={b}/run={r}" for b, r in live if b > after]
        if not paths:
            return self.spark.createDataFrame([], LOG)
        reader = self.spark.read.schema(LOG).option("basePath", f"{self.root}/log")
        return reader.parquet(*paths)

    @staticmethod
    def _snapshot(commits: list) -> int:
        return max((c["batch"] for c in commits if c["kind"] == "snapshot"), default=0)

    def log(self, doc_type: str = "*", commits: list | None = None) -> DataFrame:
        """Stored changes on top of the newest snapshot, without those of dropped collections."""
        commits = self._commits() if commits is None else commits
        snapshot = self._snapshot(commits)
        rows = self.changes(snapshot, commits).filter("outcome = 'stored'")
        if snapshot:
            base = self.spark.read.schema(LOG).parquet(f"{self.root}/snapshots/{snapshot}")
            rows = base.unionByName(rows)
        if doc_type != "*":
            rows = rows.filter(F.col("type_key") == doc_type.lower())
        for key, batch in self._dropped(commits).items():
            rows = rows.filter((F.col("type_key") != key) | (F.col("batch") > batch))
        return rows

    def current(self, doc_type: str = "*") -> DataFrame:
        """Live documents: ``doc_type, id, body VARIANT``; a snapshot without newer batches is folded already."""
        commits = self._commits()
        log, snapshot = self.log(doc_type, commits), self._snapshot(commits)
        if snapshot and not any(c["kind"] == "log" and c["batch"] > snapshot for c in commits):
            return log.select("doc_type", "id", "body")
        return fold_documents(log, keys=("doc_type", "id"))

    def view(self, doc_type: str, fields: Mapping[str, str]) -> DataFrame:
        """Typed view: ``doc_type, id`` plus the named body fields."""
        return self.current(doc_type).select(
            "doc_type",
            "id",
            *[F.try_variant_get("body", f"$['{n}']", t).alias(n) for n, t in fields.items()],
        )

    def errors(self) -> DataFrame:
        """Quarantine: ``error_type, doc_type, id, message, ts, data``."""
        return self.changes().filter("outcome <> 'stored'").select(
            F.col("outcome").alias("error_type"),
            "doc_type",
            "id",
            "message",
            "ts",
            F.to_json("body").alias("data"),
        )

    def type_exists(self, doc_type: str) -> bool:
        return not self.log(doc_type).isEmpty()

    # -- writing ---------------------------------------------------------------------------

    def _write_log(
        self, rows: DataFrame, batch: int, run: int, source: tuple[str, int] | None = None
    ) -> None:
        rows.withColumn("type_key", F.lower(F.coalesce("doc_type", F.lit("")))).write.mode(
            "overwrite"
        ).partitionBy("outcome", "type_key").parquet(f"{self.root}/log/batch={batch}/run={run}")
        self._commit(batch, "log", source=source, run=run)

    def put(
        self,
        docs: DataFrame,
        now: Column,
        analytic: str = "store",
        session: str = "session",
        upsert: bool = True,
        archive: bool = False,
        schemas: Mapping[str, Mapping] | None = None,
        chain: Callable[[DataFrame], DataFrame] | None = None,
        strict: bool = False,
        order: str | None = None,
        source: tuple[str, int] | None = None,
    ) -> int:
        """Ingest open documents (``doc_type, id, body``) and return the batch number.

        The chain runs first, then the schema check, the identity check and the field-family
        check. The documents with their place and what is wrong with them are written once; field families and
        the log, which takes stored and rejected rows into their outcome partitions, are made of that. ``strict`` raises on the first rejection
        before the batch becomes visible. ``source`` names the stream and micro-batch of the rows.
        """
        number, run = self._next_batch(), self._new_run()
        rows = chain(docs) if chain is not None else docs
        position = F.col(order) if order else F.monotonically_increasing_id()
        none = F.array().cast("array<string>")
        broken = none
        for doc_type, schema in (schemas or {}).items():
            full = rules.merge_schemas(rules.BASE_SCHEMA, schema)
            mine = F.col("doc_type") == doc_type
            broken = F.when(mine, rules.document_violations(full, rows, "body")).otherwise(broken)
        checked = rows.withColumns(
            {
                "__pos": position.cast("long"),
                "__rules": F.array_join(broken, "; "),
                "__missing": ingest.missing_identity(),
            }
        )
        checked = written(checked, "checked")
        passed = checked.filter((F.col("__rules") == "") & (F.col("__missing") == ""))
        # the log is sorted into its partitions, so a task gets a bounded number of documents
        flagged = ingest.flag_conflicts(even(checked, "__pos"), self._families(passed, number, run))
        clash = F.array_join("__bad", "; ")
        outcome = (
            F.when(F.col("__rules") != "", "jsonschema")
            .when(F.col("__missing") != "", "missing_fields")
            .when(clash != "", "BulkIndexError")
            .otherwise("stored")
        )
        stored = F.col("outcome") == "stored"
        out = flagged.withColumn("outcome", outcome).select(
            "doc_type",
            "id",
            self._place(number, run, F.col("__pos")),
            F.lit("update" if upsert else "index").alias("op"),
            now.cast("timestamp").alias("ts"),
            F.when(stored, self._sealed(analytic, session, now, archive))
            .otherwise(F.col("body"))
            .alias("body"),
            F.when(~stored, F.concat("__rules", "__missing", clash)).alias("message"),
            "outcome",
        )
        if strict:
            ingest.strictly(
                out.filter(~stored).select(F.col("outcome").alias("error_type"), "id", "message")
            )
        self._write_log(out, number, run, source)
        return number

    @staticmethod
    def _place(batch: int, run: int, pos: Column) -> Column:
        """What orders changes: batch, then run, then the place in the batch."""
        return F.struct(F.lit(batch).cast("long").alias("batch"), F.lit(run).cast("long").alias("run"), pos.cast("long").alias("pos")).alias("seq")

    def _families(self, batch: DataFrame, number: int, run: int) -> DataFrame:
        """Field families: those of earlier batches first, completed by this batch.

        Only the batch is scanned; what older batches decided is kept in a small table.
        """
        folder = f"{self.root}/families"
        ingest.field_families(batch, seq="__pos").write.mode("overwrite").parquet(
            f"{folder}/batch={number}/run={run}"
        )
        seen = self.spark.read.schema(FAMILIES).parquet(folder)
        for key, dropped in self._dropped(self._commits()).items():
            seen = seen.filter((F.lower("doc_type") != key) | (F.col("batch") > dropped))
        return seen.groupBy("doc_type", "path").agg(F.min_by("family", "batch").alias("family"))

    def _sealed(self, analytic: str, session: str, now: Column, archive: bool) -> Column:
        """Body with identity, provenance and times written into it, addressing fields removed."""
        own = {
            "id": F.col("id").cast("variant"),
            "doc_type": F.col("doc_type").cast("variant"),
        }
        if not archive:
            for name, value in (("analytic_session_id", session), ("analytic_name", analytic)):
                old = F.try_variant_get("body", f"$.{name}", "array<string>")
                merged = F.array_union(
                    F.coalesce(old, F.array().cast("array<string>")), F.array(F.lit(value))
                )
                own[name] = merged.cast("variant")
            own["@updated"] = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").cast("variant")
            own["@timestamp"] = F.coalesce(
                F.try_variant_get("body", "$['@timestamp']", "variant"), own["@updated"]
            )
        fields = F.try_variant_get("body", "$", "map<string,variant>")
        rest = F.map_filter(fields, lambda k, v: ~k.isin(*ingest.STRUCTURAL, *own))
        added = F.create_map(*[x for n, v in own.items() for x in (F.lit(n), v)])
        return F.to_variant_object(F.map_concat(rest, added))

    def delete(self, ids: DataFrame, now: Column) -> int:
        """Tombstones for ``doc_type, id`` rows (delete by id)."""
        number, run = self._next_batch(), self._new_run()
        rows = ids.select(
            "doc_type",
            "id",
            self._place(number, run, F.monotonically_increasing_id()),
            F.lit("delete").alias("op"),
            now.cast("timestamp").alias("ts"),
            F.lit(None).cast("variant").alias("body"),
            F.lit(None).cast("string").alias("message"),
            F.lit("stored").alias("outcome"),
        )
        self._write_log(rows, number, run)
        return number

    def delete_by_query(
        self, doc_type: str, fields: Mapping[str, str], clause: Clause, now: Column
    ) -> int:
        """Tombstones for every document of a typed view that satisfies the clause."""
        hits = self.view(doc_type, fields)
        return self.delete(hits.filter(clause(hits)).select("doc_type", "id"), now)

    def drop(self, doc_type: str) -> int:
        """Forget a collection and its field families; later documents start it afresh."""
        number = self._next_batch()
        self._commit(number, "drop", doc_type.lower())
        return number

    # -- upkeep ----------------------------------------------------------------------------

    def compact(self, now: Column) -> int:
        """Write the folded state as a snapshot, so reads no longer fold old history."""
        newest = self._next_batch() - 1
        state = self.current().select(
            "doc_type",
            "id",
            self._place(newest, 0, F.lit(0)),
            F.lit("index").alias("op"),
            now.cast("timestamp").alias("ts"),
            "body",
            F.lit(None).cast("string").alias("message"),
            F.lit(newest).cast("long").alias("batch"),
            F.lit(0).cast("long").alias("run"),
            F.lit("stored").alias("outcome"),
            F.lower("doc_type").alias("type_key"),
        )
        state.write.mode("overwrite").partitionBy("type_key").parquet(
            f"{self.root}/snapshots/{newest}"
        )
        self._commit(newest, "snapshot")
        return newest

    def copy_to(
        self, target: DocumentStore, doc_type: str, now: Column, where: Column | None = None
    ) -> int:
        """Copy live documents to another store without touching their provenance or times."""
        docs = self.current(doc_type)
        if where is not None:
            docs = docs.filter(where)
        return target.put(docs, now, archive=True)
