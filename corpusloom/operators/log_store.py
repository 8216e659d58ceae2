"""A keyed table as a log: small deltas, a manifest for each version, merge on read.

    path/data/<name>/bucket=<b>/     rows of one write; bucket = hash of the key
    path/manifest/<version>.json     what a version is made of

A write appends only its own rows, so its cost follows the batch and not the
table.  It commits by renaming a manifest to a name that must not exist, which
is atomic; a writer that loses the race reads the new version and tries again.
A manifest keeps the last batch number of each writer, so a batch that is run
again changes nothing.  Deletes are rows with a mark.  A read takes the newest
of each key: base rows whose key no delta has, and the deltas' last rows; the
deltas' keys are broadcast while their measured size is small.  compact() folds
deltas into the base, and rewrites the buckets that have some.  Files that no
kept version names go with vacuum().

Defined results: as store.upsert: of a batch's rows with one key the last
counts, rows without a key never replace one another; an empty batch commits
no data; a table that was never written has no rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.store import last_of_each

BUCKETS = 16
#: Deltas' keys are broadcast up to this size of their files.
BROADCAST_BYTES = 8 << 20
_OP, _SEQ, _BUCKET = "__deleted", "__seq", "bucket"


class Conflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass
class Manifest:
    version: int = 0
    key: str = ""
    buckets: int = BUCKETS
    schema: str = ""
    #: folders by bucket (as text): rows already merged
    base: dict[str, str] = field(default_factory=dict)
    #: (folder, version, bytes, buckets) in order
    deltas: list[list] = field(default_factory=list)
    writers: dict[str, int] = field(default_factory=dict)


class _Files:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def size(self, folder: str) -> int:
        p = self.path(folder)
        return self.fs.getContentSummary(p).getLength() if self.fs.exists(p) else 0

    def read(self, file: str) -> str:
        stream = self.fs.open(self.path(file))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, file: str, text: str) -> None:
        """Writes a file whole or not at all; Conflict if it exists."""
        part = self.path(f"{file}.{uuid.uuid4().hex}")
        out = self.fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(part, self.path(file), none)
        except Exception as e:
            self.fs.delete(part, False)
            if self.fs.exists(self.path(file)):
                raise Conflict(file) from e
            raise

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


class Log:
    """A table at path whose rows are found by `key`."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.at, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.files = _Files(spark, path)

    # ---- versions

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.at}/manifest") if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            version = max(self.versions(), default=0)
        return Manifest(**json.loads(self.files.read(f"{self.at}/manifest/{version:012d}.json"))) if version else Manifest(key=self.key, buckets=self.buckets)

    def _commit(self, m: Manifest) -> None:
        self.files.create(f"{self.at}/manifest/{m.version:012d}.json", json.dumps(asdict(m)))

    # ---- writes

    def write(self, rows: DataFrame, order: Column | None = None, writer: str | None = None, batch: int | None = None, attempts: int = 20) -> bool:
        """Upserts rows; False if this writer's batch is there already."""
        return self._write(last_of_each(rows, self.key, order).withColumn(_OP, F.lit(False)), writer, batch, attempts)

    def delete(self, keys: DataFrame, writer: str | None = None, batch: int | None = None, attempts: int = 20) -> bool:
        """Takes out the rows of these keys (a column named as the key)."""
        return self._write(keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct().withColumn(_OP, F.lit(True)), writer, batch, attempts)

    def _write(self, rows: DataFrame, writer: str | None, batch: int | None, attempts: int) -> bool:
        m = self.manifest()
        if self._done(m, writer, batch):
            return False
        name = f"data/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(self.key), F.lit(m.buckets)).cast("int")
        rows.withColumn(_BUCKET, bucket).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.at}/{name}")
        used = [int(n.split("=")[1]) for n in self.files.names(f"{self.at}/{name}") if n.startswith(f"{_BUCKET}=")]
        size = self.files.size(f"{self.at}/{name}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != _OP)
        for _ in range(attempts):
            if self._done(m, writer, batch):
                return False  # another run of the batch was quicker; its files are this one's equals
            m.version += 1
            m.key = self.key
            if used:
                m.deltas.append([name, m.version, size, used])
                m.schema = self._widened(m.schema, columns)
            if writer is not None:
                m.writers[writer] = batch
            try:
                self._commit(m)
                return True
            except Conflict:
                m = self.manifest()
        raise Conflict(f"{self.at}: no commit in {attempts} attempts")

    @staticmethod
    def _done(m: Manifest, writer: str | None, batch: int | None) -> bool:
        return writer is not None and batch is not None and m.writers.get(writer, -1) >= batch

    def _widened(self, known: str, new: str) -> str:
        """New columns come behind the known ones; a column keeps its first type."""
        if not known:
            return new
        have = self.spark.createDataFrame([], known).schema
        more = [f for f in self.spark.createDataFrame([], new).schema if f.name not in have.fieldNames()]
        return ", ".join([known, *(f"`{f.name}` {f.dataType.simpleString()}" for f in more)])

    # ---- reads

    def _rows(self, folders: list[str], m: Manifest) -> DataFrame:
        return self.spark.read.schema(f"{m.schema}, {_OP} boolean").parquet(*(f"{self.at}/{f}" for f in folders))

    def _last(self, m: Manifest, of: set[int] | None = None) -> DataFrame | None:
        """The deltas' newest row of each key, with its mark; of: these buckets only."""
        out = None
        for name, version, _, buckets in m.deltas:
            folders = [f"{name}/{_BUCKET}={b}" for b in buckets if of is None or b in of]
            if folders:
                rows = self._rows(folders, m).withColumn(_SEQ, F.lit(version).cast("long"))
                out = rows if out is None else out.unionAll(rows)
        if out is None:
            return None
        newest = Window.partitionBy(self.key).orderBy(F.desc(_SEQ))
        named = out.filter(F.col(self.key).isNotNull()).withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n", _SEQ)
        return named.unionAll(out.filter(F.col(self.key).isNull()).drop(_SEQ))

    def read(self, version: int | None = None, of: set[int] | None = None) -> DataFrame:
        """The table at a version, the newest unless given."""
        m = self.manifest(version)
        if not m.schema:
            raise FileNotFoundError(f"{self.at} has no rows yet")
        base = [f"{f}/{_BUCKET}={b}" for b, f in m.base.items() if of is None or int(b) in of]
        rows = self._rows(base, m).drop(_OP) if base else self.spark.createDataFrame([], m.schema)
        last = self._last(m, of)
        if last is None:
            return rows
        keys = last.select(self.key).filter(F.col(self.key).isNotNull())
        small = sum(d[2] for d in m.deltas) <= BROADCAST_BYTES
        return rows.join(F.broadcast(keys) if small else keys, self.key, "left_anti").select(*rows.columns).unionAll(last.filter(f"not {_OP}").select(*rows.columns))

    # ---- upkeep

    def compact(self) -> int:
        """Folds the deltas into the base of their buckets; returns how many buckets were rewritten."""
        m = self.manifest()
        touched = {b for d in m.deltas for b in d[3]}
        if not touched:
            return 0
        name = f"data/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(self.key), F.lit(m.buckets)).cast("int")
        rows = self.read(m.version, touched).withColumns({_OP: F.lit(False), _BUCKET: bucket})
        rows.repartition(_BUCKET, F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // m.buckets)))).write.partitionBy(_BUCKET).parquet(f"{self.at}/{name}")
        there = {n.split("=")[1] for n in self.files.names(f"{self.at}/{name}") if n.startswith(f"{_BUCKET}=")}
        folded = {d[0] for d in m.deltas}
        while True:
            now = self.manifest()
            if {b: f for b, f in now.base.items() if int(b) in touched} != {b: f for b, f in m.base.items() if int(b) in touched}:
                self.files.delete(f"{self.at}/{name}")
                raise Conflict("another compaction was quicker")
            now.version += 1
            now.base = {b: f for b, f in now.base.items() if int(b) not in touched} | {b: name for b in there}
            now.deltas = [d for d in now.deltas if d[0] not in folded]  # what came meanwhile stays
            try:
                self._commit(now)
                return len(touched)
            except Conflict:
                continue

    def vacuum(self, keep: int = 2) -> int:
        """Deletes older manifests and the folders that only they name; returns how many folders went.  No write may be under way."""
        versions = self.versions()
        kept = versions[-max(1, keep):]
        used = {f for v in kept for m in (self.manifest(v),) for f in (*m.base.values(), *(d[0] for d in m.deltas))}
        gone = [n for n in self.files.names(f"{self.at}/data") if f"data/{n}" not in used]
        for v in versions:
            if v not in kept:
                self.files.delete(f"{self.at}/manifest/{v:012d}.json")
        for n in gone:
            self.files.delete(f"{self.at}/data/{n}")
        return len(gone)
