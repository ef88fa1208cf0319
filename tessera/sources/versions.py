"""Immutable versions of a document table, in hash buckets: an update rewrites the buckets it touches and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.shared import Scratch

_MANIFEST = "bucket int, documents string, edges string"


class Versions:
    """Documents (doc_id, status, supersedes and any other columns) under a folder that driver and executors share.

    Layout: data/v=N/documents/bucket=B and data/v=N/edges/bucket=B hold what
    version N wrote; manifest/v=N names the folder of every bucket, written by N or
    by an earlier version, and is written last: a version without its manifest does
    not exist. Edges (old, by) tell which documents supersede which; they lie in the
    bucket of the old one, so an update looks up whom it retires, and who retires it,
    in buckets it can name.

    The driver holds a manifest: one row per bucket, whose number is fixed when the
    first version is written. One writer at a time; readers need no lock.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self._buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Versions that are complete, in order."""
        folder = self._path(f"{self.root}/manifest")
        found = [s.getPath() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(p.getName().split("=")[1]) for p in found if self._fs.exists(self._path(p, "_SUCCESS")))

    def _number(self, number: int | None) -> int:
        known = self.numbers()
        if not known or number is not None and number not in known:
            raise LookupError(f"version {'latest' if number is None else number} does not exist; known are {known}")
        return known[-1] if number is None else number

    def manifest(self, number: int | None = None) -> dict[int, tuple[str | None, str | None]]:
        """bucket: (folder of its documents, folder of its edges); None where there are none."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/v={self._number(number)}").collect()
        return {r.bucket: (r.documents, r.edges) for r in rows}

    def _schema(self, number: int) -> str:
        return self.spark.read.text(f"{self.root}/schema/v={number}").first().value

    def read(self, number: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The documents of a version (None: the latest), or of some of its buckets."""
        number = self._number(number)
        return self._read(self.manifest(number), 0, self._schema(number), buckets)

    def _read(self, manifest: dict, part: int, schema, buckets: set[int] | None = None) -> DataFrame:
        folders = sorted(f[part] for b, f in manifest.items() if f[part] and (buckets is None or b in buckets))
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, c: str | Column, n: int) -> Column:
        return F.pmod(F.xxhash64((F.col(c) if isinstance(c, str) else c).cast("string")), F.lit(n)).cast("int").alias("bucket")

    def upsert(self, incoming: DataFrame, number: int | None = None) -> int:
        """The version after incoming documents replaced those of the same doc_id and retired whom they supersede.

        The result is that of `knowledge.ingest` on whole tables. Buckets whose rows
        stay the same are not written; a batch that changes nothing makes no new
        version, unless it has a number of its own. A number that is complete already
        is returned as it is, so a batch may be run again. Null or repeated doc_ids
        are an error.
        """
        return self._apply(incoming, None, number)

    def delete(self, gone: DataFrame, number: int | None = None) -> int:
        """The version without the documents of the given doc_ids; those they retired stay retired."""
        return self._apply(None, gone.select("doc_id").distinct(), number)

    def _apply(self, incoming: DataFrame | None, gone: DataFrame | None, number: int | None) -> int:
        known = self.numbers()
        if number is not None and number in known:
            return number
        last = max((v for v in known if number is None or v < number), default=None)
        if number is not None and known and number < known[-1]:
            raise ValueError(f"version {number} would come before version {known[-1]}")
        if last is None and incoming is None:
            raise LookupError("there is no version to delete from")
        target = number if number is not None else (0 if last is None else last + 1)
        before = {} if last is None else self.manifest(last)
        n = len(before) or self._buckets
        scratch = Scratch(self.spark, tidy=False)
        try:
            batch = scratch.table((gone if incoming is None else incoming).withColumn("bucket", self._bucket("doc_id", n)), "batch")
            schema = batch.drop("bucket").schema if last is None else self.spark.createDataFrame([], self._schema(last)).schema
            if incoming is not None:
                if batch.where("doc_id IS NULL").limit(1).count() or batch.groupBy("doc_id").count().where("count > 1").limit(1).count():
                    raise ValueError("doc_id of an incoming document is null or repeated")
                if sorted((f.name, f.dataType.simpleString()) for f in batch.drop("bucket").schema) != sorted((f.name, f.dataType.simpleString()) for f in schema):
                    raise ValueError("incoming documents have other columns than the versions before")
            touched = {r.bucket for r in batch.select("bucket").distinct().collect()}
            ids = batch.select("doc_id")
            # Edges of replaced or deleted documents go, wherever the documents they retired lie.
            replaced = self._read(before, 0, schema, touched).join(ids, "doc_id", "left_semi").where("supersedes IS NOT NULL").select("supersedes")
            named = replaced if incoming is None else replaced.unionByName(batch.where("supersedes IS NOT NULL").select("supersedes"))
            touched |= {r.bucket for r in named.select(self._bucket("supersedes", n)).distinct().collect()}

            edge = f"old {schema['supersedes'].dataType.simpleString()}, by {schema['doc_id'].dataType.simpleString()}"
            docs, edges = self._read(before, 0, schema, touched), self._read(before, 1, edge, touched)
            edges_now = edges.join(ids.withColumnRenamed("doc_id", "by"), "by", "left_anti").select("old", "by")
            if incoming is not None:
                edges_now = edges_now.unionByName(batch.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("old"), F.col("doc_id").alias("by")))
            # What changes is found from ids, status and a digest of the rest; whole rows move once, to the bucket they are written to.
            was = scratch.table(self._light(docs, schema.names, n), "was")
            now = was.join(ids, "doc_id", "left_anti")
            if incoming is not None:
                now = now.unionByName(self._light(batch, schema.names, n))
            old = scratch.table(now.join(edges_now.select(F.col("old").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", F.lit(True).alias("_old")), "retired")
            now = now.join(old, "doc_id", "left").withColumn("status", F.when(F.col("_old"), "superseded").otherwise(F.col("status")))
            paths = {b: [*before.get(b, (None, None))] for b in range(n)}
            changed = self._changed(was, now, ["doc_id", "status", "digest"])
            self._write(f"data/v={target}/documents", 0, paths, changed, self._merged(docs, batch, incoming is None, old, schema.names, changed, n))
            by_old = lambda df: df.select("old", "by", self._bucket("old", n))
            changed = self._changed(by_old(edges), by_old(edges_now), ["old", "by"])
            self._write(f"data/v={target}/edges", 1, paths, changed, by_old(edges_now).where(F.col("bucket").isin(*changed)).repartition(max(1, len(changed)), "bucket"))
            if number is None and last is not None and all(tuple(paths[b]) == before[b] for b in paths):
                return last
        finally:
            scratch.close()
        self.spark.createDataFrame([(_simple(schema),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/schema/v={target}")
        self.spark.createDataFrame([(b, *p) for b, p in paths.items()], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={target}")
        return target

    def _light(self, df: DataFrame, names: list[str], n: int) -> DataFrame:
        """bucket, doc_id, status and the SHA-256 of all other columns."""
        digest = F.sha2(F.to_json(F.struct(*(c for c in names if c != "status")), {"ignoreNullFields": "false"}), 256)
        return df.select(self._bucket("doc_id", n), "doc_id", "status", digest.alias("digest"))

    @staticmethod
    def _changed(was: DataFrame, now: DataFrame, columns: list[str]) -> set[int]:
        """Buckets in which a row came, went or changed."""
        rows = lambda df, sign: df.select("bucket", *columns, F.lit(sign).alias("m"))
        both = rows(was, 1).unionByName(rows(now, -1)).groupBy("bucket", *columns).agg(F.sum("m").alias("m")).where("m <> 0")
        return {r.bucket for r in both.select("bucket").distinct().collect()}

    def _merged(self, docs: DataFrame, batch: DataFrame, deleted: bool, old: DataFrame, names: list[str], changed: set[int], n: int) -> DataFrame:
        """The rows of changed buckets as they are now. Rows, ids that go and ids that are retired are dealt to buckets together, which is the only exchange."""
        ours = lambda df, side: df.select(*(c for c in names if c in df.columns), self._bucket("doc_id", n), F.lit(side).alias("_side")).where(F.col("bucket").isin(*changed))
        every = ours(docs, "held").unionByName(ours(batch, "gone" if deleted else "new"), allowMissingColumns=True).unionByName(ours(old, "retired"), allowMissingColumns=True)
        same = Window.partitionBy("bucket", "doc_id")
        met = lambda *sides: F.max(F.col("_side").isin(*sides)).over(same)
        told = every.repartition(max(1, len(changed)), "bucket").withColumns({"_replaced": met("new", "gone"), "_old": met("retired")})
        kept = told.where((F.col("_side") == "new") | ((F.col("_side") == "held") & ~F.col("_replaced")))
        return kept.withColumn("status", F.when(F.col("_old"), "superseded").otherwise(F.col("status"))).select(*names, "bucket")

    def _write(self, folder: str, part: int, paths: dict[int, list], changed: set[int], rows: DataFrame) -> None:
        if not changed:
            return
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{folder}")
        for b in changed:
            there = self._fs.exists(self._path(f"{self.root}/{folder}/bucket={b}"))
            paths[b][part] = f"{folder}/bucket={b}" if there else None


def _simple(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
