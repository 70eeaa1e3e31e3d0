"""A stored table that takes upserts: rows by bucket of their key, a manifest that says which files are the table.

An upsert rewrites the buckets that its changes hit and no others: it writes them to new folders, then puts a new manifest
in place by one rename.  Whoever reads sees the table before or after, never between; a run that fails leaves files that no
manifest names, and can be repeated.  Changes that lack a key, or of which a key has several that differ, go to a table of
rejects with the reason, and do not stop the rest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import upsert


class StoredTable:
    """path: a folder that all executors share; key: columns; buckets: of the key's hash, fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _store(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _manifest(self) -> dict:
        """The newest manifest: version, schema, buckets, files {bucket: folder}; only whole ones have their name."""
        store, folder = self._store(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in store.listStatus(folder)] if store.exists(folder) else []
        last = max((n for n in names if n.endswith(".json")), default=None)
        if last is None:
            raise ValueError(f"{self.path} holds no table")
        text = self.spark.read.text(f"{self.path}/manifests/{last}", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        """Writes the manifest aside and renames it; a version that is there already is someone else's, and stays."""
        store, aside = self._store(f"{self.path}/aside-{uuid.uuid4().hex}")
        stream = store.create(aside)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        _, place = self._store(f"{self.path}/manifests/{manifest['version']:012d}.json")
        store.mkdirs(place.getParent())
        if store.exists(place) or not store.rename(aside, place):
            store.delete(aside, True)
            raise RuntimeError(f"version {manifest['version']} of {self.path} was written by another run")

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.key]), F.lit(buckets)).cast("int")

    def create(self, rows: DataFrame, buckets: int = 32) -> None:
        """Version 0; rows have one row a key."""
        self._write(rows, list(range(buckets)), {"version": -1, "schema": rows.schema.json(), "buckets": buckets, "files": {}})

    def _write(self, rows: DataFrame, hit: list[int], old: dict) -> None:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(old["buckets"])).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        store, _ = self._store(self.path)
        there = {b: f"{folder}/_bucket={b}" for b in hit}
        filled = {str(b): place for b, place in there.items() if store.exists(self._store(place)[1])}
        files = {b: place for b, place in old["files"].items() if int(b) not in there} | filled
        self._commit(old | {"version": old["version"] + 1, "files": files})

    def read(self, hit: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """The newest version, or those of its buckets."""
        from pyspark.sql.types import StructType

        manifest = manifest or self._manifest()
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        places = [place for b, place in manifest["files"].items() if hit is None or int(b) in hit]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def upsert(self, changes: DataFrame, kept: list[str]) -> DataFrame:
        """Applies changes and gives the rejected ones: the columns of changes and reason.  kept: columns that stay as they are."""
        manifest = self._manifest()
        changes = changes.select(*changes.columns).distinct()
        without = F.coalesce(*[F.when(F.col(k).isNull(), True) for k in self.key], F.lit(False))
        times = changes.where(~without).groupBy(*self.key).agg(F.count("*").alias("_times"))
        marked = changes.join(times, self.key, "left").withColumn("reason", F.when(without, "no key").when(F.col("_times") > 1, "several changes of a key"))
        good = marked.where("reason is null").select(*changes.columns)
        # one row a bucket, as many as the table was made with
        hit = sorted(r[0] for r in good.select(self._bucket(manifest["buckets"])).distinct().collect())
        if hit:
            self._write(upsert(self.read(hit, manifest), good, self.key, kept), hit, manifest)
        return marked.where("reason is not null").select(*changes.columns, "reason")
