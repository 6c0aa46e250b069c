"""Versioned tables of the stream, committed together.

Every commit is a manifest, a small file with the next number, that names what each table consists of; it is written aside and renamed into place,
so a reader sees all tables of a commit or none. Files that no manifest names count for nothing: a run that dies between two writes changes nothing, and is simply run again.

``state`` and ``texts`` are cut by source into buckets. A bucket is a base and the deltas written since; of a posting the row with the highest version
counts. A cycle reads the buckets of the sources it has a snapshot of, and writes the rows that changed; other files keep their names. When a posting was
last seen isn't written for each: an open row that is ``tracked`` was seen whenever its source's snapshot was accepted, and that is a column of the
source table. So what a cycle writes grows with what changed, not with what is open. ``compact`` merges the deltas of buckets that have gathered many.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import diff as D
from tidemark.operators.names import ENTRIES

STATE = f"{D.SLIM}, version bigint"
TEXTS = "source_id bigint, key string, description string, version bigint"
EVENTS = "event_id string, source_id bigint, key string, type string, payload string, created_at timestamp"
SOURCES = "source_id bigint, kind string, ident string, complete boolean, fail_count int, etag string, last_poll timestamp, filter_hash string, seen_at timestamp"
PAGES = "cycle bigint, as_of timestamp, source_id bigint, kind string, ident string, page_no int, status string, etag string, payload string"
KEYED = {"state": STATE, "texts": TEXTS}


def columns(schema: str) -> list[str]:
    return [c.strip().split()[0] for c in schema.split(",")]


class Store:
    """Tables under ``folder``, which all executors see. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, most_deltas: int = 8):
        self.spark, self.folder, self.buckets, self.most_deltas = spark, folder.rstrip("/"), buckets, most_deltas

    # ---- files ----
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("manifests").getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, name: str) -> list[str]:
        fs, p = self._fs(), self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def manifest(self, number: int | None = None) -> dict:
        """A commit, the last one unless ``number`` tells it; before the first one there is an empty one."""
        if number is None:
            numbers = [int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and not n.startswith(".")]
            if not numbers:
                return {"number": 0, "cycle": None, "state": {}, "texts": {}, "sources": None, "events": None, "pages": [], "names": [], "buckets": self.buckets}
            number = max(numbers)
        stream = self._fs().open(self._path(f"manifests/{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, manifest: dict) -> None:
        """The commit: all at once by a rename."""
        fs, name = self._fs(), f"manifests/{manifest['number']:012d}.json"
        aside, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(name)
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        if fs.exists(final) or not fs.rename(aside, final):
            fs.delete(aside, False)
            raise RuntimeError(f"{name} is there already: another writer was faster")

    # ---- reading ----
    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("source_id"), F.lit(self.buckets)).cast("int")

    def buckets_of(self, sources: DataFrame) -> list[int]:
        """At most as many numbers as there are buckets."""
        return sorted(r["b"] for r in sources.select(self.bucket().alias("b")).distinct().collect())

    def _frame(self, paths: list[str], schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths])

    def keyed(self, name: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """The rows of ``state`` or ``texts`` that count, in these buckets (None: all). No other bucket's files are read."""
        mine = [e for b, e in sorted(manifest[name].items()) if buckets is None or int(b) in buckets]
        base = self._frame([e["base"] for e in mine if e["base"]], KEYED[name])
        deltas = [p for e in mine for p in e["deltas"]]
        if not deltas:
            return base
        whole = F.struct(*columns(KEYED[name]))
        newest = self._frame(deltas, KEYED[name]).groupBy("source_id", "key").agg(F.max_by(whole, "version").alias("r")).select("r.*")
        return base.join(newest.select("source_id", "key"), ["source_id", "key"], "left_anti").unionByName(newest)

    def state(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """State rows with ``last_seen`` as it is; see ``diff.SLIM``."""
        seen = self.sources(manifest).select("source_id", "seen_at")
        rows = self.keyed("state", manifest, buckets).drop("version").join(seen, "source_id", "left")
        return rows.withColumn("last_seen", F.when(F.col("tracked"), F.coalesce("seen_at", "last_seen")).otherwise(F.col("last_seen"))).select(*columns(D.SLIM))

    def described(self, manifest: dict) -> DataFrame:
        """The whole state with its texts, as ``diff.STATE`` has it."""
        texts = self.keyed("texts", manifest).drop("version")
        return self.state(manifest).join(texts, ["source_id", "key"], "left").select(*D.state_columns())

    def sources(self, manifest: dict) -> DataFrame:
        return self._frame([manifest["sources"]] if manifest["sources"] else [], SOURCES)

    def events(self) -> DataFrame:
        """All committed events."""
        paths = [m["events"] for m in map(self.manifest, range(1, self.manifest()["number"] + 1)) if m["events"]]
        return self._frame(paths, EVENTS)

    def names(self, manifest: dict) -> DataFrame:
        """The dictionary of normalised strings; see ``operators.names``."""
        return self._frame(manifest["names"], ENTRIES)

    def pages(self, manifest: dict) -> DataFrame:
        """Landed pages of cycles that haven't ended."""
        return self._frame(manifest["pages"], PAGES)

    # ---- writing: nothing counts until it is published ----
    def write(self, name: str, rows: DataFrame, number: int) -> str:
        path = f"{name}/{number:012d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.folder}/{path}")
        return path

    def write_keyed(self, name: str, rows: DataFrame, number: int, dealt: bool = False) -> dict[str, str]:
        """Rows by bucket: {bucket: path} of the buckets that got any."""
        out = rows.withColumn("version", F.lit(number).cast("long")).select(*columns(KEYED[name])).withColumn("bucket", self.bucket())
        out = out.repartitionByRange("bucket", "source_id", "key") if dealt else out
        path = f"{name}/{number:012d}-{uuid.uuid4().hex[:8]}"
        out.write.partitionBy("bucket").parquet(f"{self.folder}/{path}")
        return {n.split("=")[1]: f"{path}/{n}" for n in self._names(path) if n.startswith("bucket=")}

    def scratch(self, df: DataFrame) -> DataFrame:
        """``df`` written aside and read back: short plans, and nothing is computed twice. ``swept`` deletes it."""
        path = f"scratch/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{path}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{path}")

    def swept(self) -> None:
        self._fs().delete(self._path("scratch"), True)

    def grown(self, manifest: dict, **deltas: dict[str, str]) -> dict:
        """The next manifest, with these deltas on top."""
        out = json.loads(json.dumps(manifest)) | {"number": manifest["number"] + 1, "events": None}
        for name, paths in deltas.items():
            for b, path in paths.items():
                entry = out[name].setdefault(b, {"base": None, "deltas": []})
                entry["deltas"].append(path)
        return out

    def compact(self, force: bool = False) -> bool:
        """Merge the deltas of buckets with more than ``most_deltas`` into new bases; a commit of its own."""
        m = self.manifest()
        out = self.grown(m)
        for name in KEYED:
            full = [int(b) for b, e in m[name].items() if e["deltas"] and (force or len(e["deltas"]) > self.most_deltas)]
            if full:
                made = self.write_keyed(name, self.keyed(name, m, full).drop("version"), out["number"], dealt=True)
                out[name] |= {str(b): {"base": made.get(str(b)), "deltas": []} for b in full}
        if len(m["names"]) > self.most_deltas or (force and len(m["names"]) > 1):
            out["names"] = [self.write("names", self.names(m).dropDuplicates(["kind", "raw", "remote"]), out["number"])]
        changed = any(out[n] != m[n] for n in (*KEYED, "names"))
        if changed:
            self.publish(out)
        return changed
