"""Tables whose changes are committed whole: data folders that are never rewritten, and numbered manifests that name them.

A batch writes its folders first and then one manifest, by a rename that only one writer can win. Readers follow a manifest, so
they see all of a batch or nothing of it, and what they read stays as it is. A batch that is replayed is recognised by its number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators.retrieval import upsert


class Conflict(RuntimeError):
    """Another writer has committed the same version."""


class VersionedTable:
    """A table under ``path``, parted by the column ``part`` (few values a batch), with rows told apart by ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], part: str):
        self.spark, self.path, self.key, self.part = spark, path.rstrip("/"), list(key), part
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """The committed versions, in order."""
        where = self._at("manifests")
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version, the last unless told otherwise, holds; an empty table before the first."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "batch": None, "schema": None, "parts": {}}
        stream = self._fs.open(self._at(f"manifests/{version if version is not None else known[-1]:012d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None, parts: Sequence[str] | None = None) -> DataFrame | None:
        """The rows of a version, or of some of its parts; nothing before the first."""
        held = self.manifest(version)
        if held["schema"] is None:
            return None
        folders = sorted({f for p, f in held["parts"].items() if parts is None or p in parts})
        schema = T.StructType.fromJson(held["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _commit(self, held: dict) -> None:
        staged, final = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{held['version']:012d}.json")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(held, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            self._fs.delete(staged, False)
            raise Conflict(f"version {held['version']} is committed already")

    def merge(self, changes: DataFrame, batch: int | None = None, keep: Sequence[str] = ()) -> int:
        """Upserts ``changes`` and commits them as one version, which is returned.

        Only the parts that they touch are read and written anew, each into a folder of its own. A ``batch`` that is not above
        the last committed one changes nothing. Changes must differ in ``key``; a null part is one of its own.
        """
        held = self.manifest()
        if batch is not None and held["batch"] is not None and batch <= held["batch"]:
            return held["version"]
        new = changes.withColumn("_part", F.coalesce(F.col(self.part).cast("string"), F.lit("null"))).persist()
        try:
            touched = [r[0] for r in new.select("_part").distinct().collect()]
            if not touched and batch is None:
                return held["version"]
            schema = held["schema"] or changes.schema.jsonValue()
            parts = dict(held["parts"])
            folder = f"data/{held['version'] + 1:012d}-{uuid.uuid4().hex}"
            if touched:
                old = self.read(held["version"], touched) if held["schema"] else None
                rows = new.drop("_part") if old is None else upsert(old, new.drop("_part"), self.key, keep)
                number = {p: f"{folder}/{i}" for i, p in enumerate(sorted(touched))}
                # all parts in one job; the folder's number stands for the part
                label = F.coalesce(F.col(self.part).cast("string"), F.lit("null"))
                at = F.element_at(F.create_map(*[x for p, f in number.items() for x in (F.lit(p), F.lit(f.rsplit("/", 1)[1]))]), label)
                rows.withColumn("_at", at).write.partitionBy("_at").parquet(f"{self.path}/{folder}")
                parts |= {p: f"{folder}/_at={f.rsplit('/', 1)[1]}" for p, f in number.items()}
            self._commit({"version": held["version"] + 1, "batch": batch if batch is not None else held["batch"], "schema": schema, "parts": parts})
            return held["version"] + 1
        finally:
            new.unpersist()

    def vacuum(self, versions: int = 2) -> list[str]:
        """Deletes data folders that none of the last ``versions`` versions names, also those of batches that never committed,
        and older manifests; the folders deleted. Not to be run beside a writer."""
        known = self.versions()
        kept = {f.split("/")[1] for v in known[-versions:] for f in self.manifest(v)["parts"].values()}
        gone = []
        if self._fs.exists(self._at("data")):
            for s in self._fs.listStatus(self._at("data")):
                if s.getPath().getName() not in kept:
                    self._fs.delete(s.getPath(), True)
                    gone.append(s.getPath().getName())
        for v in known[:-versions]:
            self._fs.delete(self._at(f"manifests/{v:012d}.json"), False)
        return gone
