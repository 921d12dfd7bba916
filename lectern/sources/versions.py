"""A store of tables that change together: every commit appends, and one manifest makes all of it visible at once."""

from __future__ import annotations

import functools
import json
import math
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Segments of like size that are merged into one, the size up to which they count as alike, and bytes of a merged file.
FAN, LEAST, FILE = 4, 8 << 20, 128 << 20
#: The store's own tables: which documents a segment holds, and which documents' older rows it makes void.
HELD, DEAD = "_held", "_dead"


class StoreConflict(RuntimeError):
    """Another writer has committed in the meantime; nothing of this commit is visible."""


class Store:
    """Tables keyed by document_id under one path.

    A commit writes a segment: a folder of new files for each table. Nothing that is there is rewritten, so it costs what
    it brings. Documents that were there already are listed as void below the new version, in a table of the segment;
    readers leave such rows out. The last act of a commit is to put its manifest, a list of all segments, in place under
    the next version's name, which fails if another writer was faster. A commit that dies before that leaves files that
    no manifest names, and readers see the version before, of all tables alike. Readers of a version keep it, since no
    commit deletes files; vacuum() does.
    """

    def __init__(self, spark: SparkSession, path: str, order: dict[str, str] | None = None, folders: dict[str, str] | None = None):
        """order: the column that a table's files lie in order of; folders: the column that a table has a folder for each
        value of, few values."""
        self.spark, self.path, self.order, self.folders = spark, path, order or {}, folders or {}

    # Files

    def _at(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _size(self, name: str) -> int:
        fs, p = self._at(name)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, of the latest one by default; one without segments where nothing is stored."""
        known = self.versions()
        if not known:
            return {"version": 0, "segments": [], "schemas": {}}
        fs, p = self._at(f"manifests/{max(known) if version is None else version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> int:
        """Put a manifest in place: written aside and renamed, which is one act and never replaces a file."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, aside = self._at(f"manifests/.{uuid.uuid4().hex}")
        stream = fs.create(aside, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        _, there = self._at(f"manifests/{manifest['version']:012d}.json")
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(aside), fs.makeQualified(there), how)
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(there):
                raise StoreConflict(f"version {manifest['version']} is there already") from e
            raise
        return manifest["version"]

    # Reading

    def _rows(self, name: str, manifest: dict, segments: Iterable[dict]) -> DataFrame:
        """A table's rows in some segments, void ones too, with `version`, that of their segment."""
        schema = S.StructType.fromJson(manifest["schemas"][name])
        paths = [f"{self.path}/data/{name}/seg={s['name']}" for s in segments if name in s["tables"]]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("version", F.lit(0).cast("long"))
        read = self.spark.read.schema(S.StructType([*schema, S.StructField("seg", S.StringType())])).option("basePath", f"{self.path}/data/{name}").parquet(*paths)
        return read.withColumn("version", F.substring("seg", 2, 12).cast("long")).drop("seg")

    def _live(self, name: str, manifest: dict, segments: list[dict]) -> DataFrame:
        last = max((s["version"] for s in manifest["segments"] if DEAD in s["tables"]), default=0)
        fresh = [s for s in segments if s["version"] >= last]
        rows = self._rows(name, manifest, fresh)
        if len(fresh) < len(segments):
            # Only segments older than the last void list are looked through.
            void = self._rows(DEAD, manifest, manifest["segments"]).groupBy(F.col("document_id").alias("void_id")).agg(F.max("version").alias("below"))
            old = self._rows(name, manifest, [s for s in segments if s["version"] < last])
            old = old.join(void, (F.col("document_id") == F.col("void_id")) & (F.col("version") < F.col("below")), "left_anti")
            rows = rows.unionByName(old) if fresh else old
        return rows.drop("version")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the latest by default."""
        manifest = self.manifest(version)
        if name not in manifest["schemas"]:
            raise KeyError(f"no table {name} is stored under {self.path}")
        return self._live(name, manifest, manifest["segments"])

    # Following

    def since(self, name: str, version: int, now: dict) -> DataFrame:
        """The rows of a table in the state `now`, a manifest, that commits after a version brought; all from -1 on. Merging
        may bring older rows again, never fewer."""
        if name not in now["schemas"]:
            raise KeyError(f"no table {name} is stored under {self.path}")
        return self._live(name, now, [s for s in now["segments"] if s["version"] > version])

    def touched(self, version: int, now: dict) -> DataFrame:
        """(document_id) of all documents that commits after a version stored, stored again or removed. That is known back to
        the version that `now` calls forgotten: before, lists of what was removed may have been merged away."""
        later = [s for s in now["segments"] if s["version"] > version]
        ids = [self._rows(t, now, later).select("document_id") for t in (HELD, DEAD) if t in now["schemas"]]
        return functools.reduce(DataFrame.unionByName, ids).distinct()

    def held(self) -> DataFrame | None:
        """(document_id) of all documents that are stored now, None where nothing ever was."""
        return self.read(HELD).distinct() if HELD in self.manifest()["schemas"] else None

    # Writing

    def _write(self, tables: dict[str, DataFrame], version: int, files: dict[str, int] | None = None) -> dict:
        """A segment of new files, not visible yet. Tables are written at the same time: each alone may leave cores idle."""
        name = f"v{version:012d}-{uuid.uuid4().hex[:12]}"

        def write(item):
            table, rows = item
            if files is not None:
                rows = rows.coalesce(files.get(table, 1))
            if table in self.order:
                rows = rows.sortWithinPartitions(self.order[table])
            writer = rows.write
            if table in self.folders:
                writer = writer.partitionBy(self.folders[table])
            writer.parquet(f"{self.path}/data/{table}/seg={name}")
            return table, self._size(f"data/{table}/seg={name}")

        with ThreadPoolExecutor(max(1, len(tables))) as pool:
            return {"name": name, "version": version, "tables": dict(pool.map(write, tables.items()))}

    def note(self, key: str) -> int:
        """The number that the last commit with a note under this key has, -1 without any."""
        return self.manifest().get("notes", {}).get(key, -1)

    def commit(self, tables: dict[str, DataFrame], documents: DataFrame, note: tuple[str, int] | None = None) -> int:
        """Store documents' rows in some tables, and the new version. `documents` (document_id) says whose rows these are,
        whether they have any: all that was stored of them before, in any table, is void from now on. note: a number kept
        under a key, a stream's batch, say, which becomes visible with the commit."""
        now = self.manifest()
        version = now["version"] + 1
        ids = documents.select(F.col("document_id").cast("long").alias("document_id")).where("document_id is not null").distinct()
        written = {**tables, HELD: ids}
        if now["segments"]:
            written[DEAD] = ids.join(self._live(HELD, now, now["segments"]), "document_id", "left_semi")
        return self._add(now, written, note)

    def remove(self, documents: DataFrame) -> int:
        """Remove documents (document_id) from all tables; what isn't stored isn't missed."""
        now = self.manifest()
        if not now["segments"]:
            return now["version"]
        ids = documents.select(F.col("document_id").cast("long").alias("document_id")).distinct()
        return self._add(now, {DEAD: ids.join(self._live(HELD, now, now["segments"]), "document_id", "left_semi")})

    def _add(self, now: dict, tables: dict[str, DataFrame], note: tuple[str, int] | None = None) -> int:
        version = now["version"] + 1
        segment = self._write(tables, version)
        if DEAD in tables and self.spark.read.parquet(f"{self.path}/data/{DEAD}/seg={segment['name']}").isEmpty():
            del segment["tables"][DEAD]
        schemas = now["schemas"] | {t: json.loads(d.schema.json()) for t, d in tables.items()}
        notes = now.get("notes", {}) | (dict([note]) if note else {})
        return self._publish({**now, "version": version, "segments": [*now["segments"], segment], "schemas": schemas, "notes": notes})

    def compact(self, fan: int = FAN, least: int = LEAST, derive: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None) -> int | None:
        """Merge `fan` or more segments of like size into one without void rows: the new version, or None where none are so
        many. Sizes are alike within a factor of `fan`, so a row is rewritten as often as its store grows by that factor.
        derive: what is to be made of the merged tables, where rows are laid out by what lies beside them."""
        now = self.manifest()
        tiers: dict[int, list[dict]] = {}
        for s in now["segments"]:
            size = sum(s["tables"].values())
            tiers.setdefault(0 if size < least else 1 + int(math.log(size / least, fan)), []).append(s)
        chosen = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= fan), None)
        if chosen is None:
            return None
        names = sorted({t for s in chosen for t in s["tables"]} - {DEAD})
        tables = {t: self._live(t, now, chosen) for t in names}
        files = {t: max(1, -(-sum(s["tables"].get(t, 0) for s in chosen) // FILE)) for t in names}
        # The merged rows' version is the largest of theirs: whatever made older ones void has been applied.
        segment = self._write(derive(tables) if derive else tables, max(s["version"] for s in chosen), files)
        kept = [s for s in now["segments"] if s not in chosen]
        voids = [{**s, "tables": {DEAD: s["tables"][DEAD]}} for s in chosen if DEAD in s["tables"]]
        oldest = min((s["version"] for s in [*kept, segment] if set(s["tables"]) - {DEAD}), default=0)
        # A void list that only concerns rows which are gone has nothing left to say.
        left = [s for s in [*kept, *voids] if set(s["tables"]) - {DEAD} or s["version"] > oldest]
        forgotten = max((s["version"] for s in [*kept, *voids] if DEAD in s["tables"] and s not in left), default=0)
        return self._publish({**now, "version": now["version"] + 1, "segments": [*left, segment], "forgotten": max(forgotten, now.get("forgotten", 0))})

    def vacuum(self, keep: int = 2) -> int:
        """Delete what no manifest of the last `keep` versions names, and how many segments' folders those were. For times
        when nobody writes: a commit on its way has files that no manifest names yet."""
        known = self.versions()
        wanted = {s["name"] for v in known[-keep:] for s in self.manifest(v)["segments"]}
        gone = 0
        for table in self._names("data"):
            for folder in self._names(f"data/{table}"):
                if folder.startswith("seg=") and folder[4:] not in wanted:
                    fs, p = self._at(f"data/{table}/{folder}")
                    fs.delete(p, True)
                    gone += 1
        for v in known[:-keep]:
            fs, p = self._at(f"manifests/{v:012d}.json")
            fs.delete(p, False)
        return gone
