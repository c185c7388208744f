"""A table of findings in versions: a replacement shows in full or not at all, wherever a job is lost.

A version is a manifest, a small file that names the folder of each bucket. Replacing writes new folders for the buckets it
touches, and one rename that cannot overwrite makes the next manifest; the folders of earlier versions stay as they
are and readable until they are released. Two jobs that start from one version cannot both make the next.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscore.sources.sinks import FINDING_BUCKETS, with_bucket

_MANIFEST = re.compile(r"^v(\d{8})\.json$")


class FindingsTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = FINDING_BUCKETS):
        """`buckets` is that of the first write; more of them make smaller rewrites."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _place(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._place("").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder = self._place("versions")
        if not self._files().exists(folder):
            return []
        names = [str(s.getPath().getName()) for s in self._files().listStatus(folder)]
        return sorted(int(m.group(1)) for m in map(_MANIFEST.match, names) if m)

    def _manifest(self, version: int) -> dict:
        stream = self._files().open(self._place(f"versions/v{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or an older one that is not released."""
        known = self.versions()
        manifest = self._manifest(known[-1] if version is None else version)
        schema = self.spark.createDataFrame([], manifest["schema"]).schema
        folders = [f"{self.path}/{f}" for f in manifest["buckets"].values()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def stage(self, findings: DataFrame) -> dict:
        """Writes the new folders and returns the manifest that would name them; readers see nothing of it.

        All findings of the audits at hand are replaced; other audits of their buckets are carried over by an anti join.
        """
        known = self.versions()
        before = self._manifest(known[-1]) if known else {"version": 0, "buckets": {}, "count": self.buckets, "schema": None}
        fresh = with_bucket(findings, before["count"])
        rows = fresh
        if known:
            audits = fresh.select("audit_id", "bucket").distinct()
            touched = {str(r.bucket) for r in audits.select("bucket").distinct().collect()}  # as many as buckets
            folders = [f"{self.path}/{f}" for b, f in before["buckets"].items() if b in touched]
            if folders:
                old = self.spark.read.schema(findings.schema).parquet(*folders)
                kept = old.join(audits.select("audit_id"), "audit_id", "left_anti").select(*findings.columns)
                rows = with_bucket(kept, before["count"]).unionByName(fresh)
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        listed = [str(s.getPath().getName()) for s in self._files().listStatus(self._place(folder))]
        new = {n.removeprefix("bucket="): f"{folder}/{n}" for n in listed if n.startswith("bucket=")}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in findings.schema.fields)
        return {"version": before["version"] + 1, "count": before["count"], "schema": schema,
                "buckets": {**before["buckets"], **new}}

    def commit(self, manifest: dict) -> int:
        """Makes a staged version the newest one, by one rename; fails if another job has made this version."""
        draft = self._place(f"versions/draft-{uuid.uuid4().hex}")
        stream = self._files().create(draft)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        fs = self._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
        context = fs.FileContext.getFileContext(draft.getFileSystem(self._conf).getUri(), self._conf)
        final = self._place(f"versions/v{manifest['version']:08d}.json")
        context.rename(context.makeQualified(draft), context.makeQualified(final), none)
        return manifest["version"]

    def replace(self, findings: DataFrame) -> int:
        """Replaces all findings of the audits at hand; the new version's number."""
        return self.commit(self.stage(findings))

    def release(self, keep: int = 1) -> list[int]:
        """Drops all but the newest `keep` versions, then the folders that no version names; the dropped numbers.

        Not while a replacement is being staged, whose folders no version names yet.
        """
        known = self.versions()
        dropped = known[:-keep] if keep else known
        for version in dropped:
            self._files().delete(self._place(f"versions/v{version:08d}.json"), False)
        used = {f for v in known[len(dropped):] for f in self._manifest(v)["buckets"].values()}
        for data in self._files().listStatus(self._place("data")):
            name = str(data.getPath().getName())
            for bucket in self._files().listStatus(data.getPath()):
                if f"data/{name}/{bucket.getPath().getName()}" not in used:
                    self._files().delete(bucket.getPath(), True)
        return dropped
