"""Publication of an index in two phases: staged by tasks, checked, then pointed to in one step.

A version is a folder of Parquet files with a manifest.  Tasks write files of names of their own, and report what they wrote;
only when all have, one commit writes the manifest of just these files, so files of failed or repeated attempts count
for nothing.  A version is read by its manifest; readers follow a pointer, which is replaced by one rename once the
staged version has been checked.  Until then, whatever fails, the version before stays what is read.

A version before that is damaged costs only the work of building anew what is lost: each file's checksum is
tested in tasks before its rows are taken.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from docfathom.functions.vectors import finite, nonzero
from docfathom.operators.integrity import changes, completeness

#: Name of the source, of a version's list of files, of the pointer; rows of a file at most; bytes that are hashed at once.
FORMAT, MANIFEST, POINTER, FILE_ROWS, PIECE = "docfathom_publication", "manifest.json", "current.json", 1_000_000, 1 << 20


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and a path in it, of a URI or of a local path."""
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def _digest(system: fs.FileSystem, path: str) -> str:
    out = hashlib.sha256()
    with system.open_input_stream(path) as f:
        while piece := f.read(PIECE):
            out.update(piece)
    return out.hexdigest()


def _replace(system: fs.FileSystem, path: str, text: str) -> None:
    """Write beside the place and rename: a reader sees the old text or the new one."""
    beside = f"{path}.next-{uuid.uuid4().hex}"
    with system.open_output_stream(beside) as f:
        f.write(text.encode())
    system.move(beside, path)


def _json(system: fs.FileSystem, path: str) -> dict | None:
    """A small file's object; None if it isn't there or is torn."""
    try:
        with system.open_input_stream(path) as f:
            got = json.loads(f.read())
        return got if isinstance(got, dict) else None
    except (OSError, ValueError):
        return None


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: name, rows, sha256."""

    files: list[tuple[str, int, str]]


class Staging(DataSourceArrowWriter):
    """Writes a version's files, in tasks, and its manifest, once."""

    def __init__(self, folder: str, version: str):
        self.folder, self.version = folder, version

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = _place(f"{self.folder}/{self.version}")
        system.create_dir(base, recursive=True)
        files: list[tuple[str, int, str]] = []
        writer, name, rows = None, "", 0

        def close() -> None:
            writer.close()
            files.append((name, rows, _digest(system, f"{base}/{name}")))

        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                name, rows = f"part-{uuid.uuid4().hex}.parquet", 0
                writer = pyarrow.parquet.ParquetWriter(f"{base}/{name}", batch.schema, filesystem=system)
            writer.write_batch(batch)
            rows += batch.num_rows
            if rows >= FILE_ROWS:
                close()
                writer = None
        if writer is not None:
            close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = _place(f"{self.folder}/{self.version}")
        system.create_dir(base, recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        _replace(system, f"{base}/{MANIFEST}", json.dumps({"version": self.version, "rows": sum(n for _, n, _ in files), "files": [{"name": a, "rows": n, "sha256": h} for a, n, h in files]}))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Drop what was staged; nothing points to it."""
        system, base = _place(f"{self.folder}/{self.version}")
        if system.get_file_info(base).type == fs.FileType.Directory:
            system.delete_dir(base)


class Publication(DataSource):
    """``df.write.format(FORMAT).option("path", folder).option("version", version).mode("append").save()`` stages a version."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> Staging:
        return Staging(self.options["path"], self.options["version"])


def stage(rows: DataFrame, folder: str, version: str) -> None:
    """Write ``rows`` as a version that nothing points to yet."""
    rows.sparkSession.dataSource.register(Publication)
    rows.write.format(FORMAT).option("path", folder).option("version", version).mode("append").save()


def current(folder: str) -> str | None:
    """The version that readers see; None if there is none or the pointer is torn."""
    system, base = _place(folder)
    got = _json(system, f"{base}/{POINTER}")
    return got.get("version") if got else None


def point(folder: str, version: str) -> None:
    """Let readers see a staged version; giving an older one rolls back."""
    system, base = _place(folder)
    if _json(system, f"{base}/{version}/{MANIFEST}") is None:
        raise ValueError(f"version {version} is not staged")
    _replace(system, f"{base}/{POINTER}", json.dumps({"version": version}))


def read(spark: SparkSession, folder: str, schema: str, version: str | None = None) -> DataFrame:
    """Rows of a version, by default the current one; none of no version."""
    version = version or current(folder)
    system, base = _place(folder)
    listed = (_json(system, f"{base}/{version}/{MANIFEST}") or {}) if version else {}
    names = [f"{folder}/{version}/{f['name']}" for f in listed.get("files", [])]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def undamaged(spark: SparkSession, folder: str, schema: str, version: str | None = None) -> DataFrame:
    """Rows of those files of a version whose checksum is right; none where pointer or manifest are torn.

    Files are hashed in tasks, piece by piece; the driver holds their names only, as any listing does.
    """
    version = version or current(folder)
    system, base = _place(folder)
    listed = (_json(system, f"{base}/{version}/{MANIFEST}") or {}).get("files", []) if version else []
    if not listed:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(f["name"], f["sha256"]) for f in listed], "name string, sha256 string").repartition(min(len(listed), 10_000))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = _place(f"{folder}/{version}")
        for batch in batches:
            good = []
            for name, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    good.append(_digest(own, f"{at}/{name}") == sha)
                except OSError:
                    good.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good))], names=["name"])

    names = [f"{folder}/{version}/{r['name']}" for r in files.mapInArrow(test, "name string").collect()]
    return spark.read.schema(schema).parquet(*sorted(names)) if names else spark.createDataFrame([], schema)


VECTORS = "id string, content_hash string, fingerprint string, values array<double>"


def publish(chunks: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str, fingerprint: str, dimensions: int, seeds: DataFrame | None = None, version: str | None = None) -> dict:
    """Bring the vectors in ``folder`` to the state of ``chunks`` (id, content_hash, what ``build`` needs), all or nothing.

    Vectors of the current version, or of ``seeds`` (the columns VECTORS) if given, are used again where hash, fingerprint
    and dimensions are right; ``build`` gives (id, values) of the others.  The staged version is compared with
    ``chunks`` and its file's checksums before readers see it, and if a chunk has no vector, or a zero one, they never do: the report
    says ``published`` False and the version before stays.  Ids of ``chunks`` must be unique; with no chunks an empty version is published.
    """
    spark, version = chunks.sparkSession, version or f"v-{uuid.uuid4().hex}"
    known = undamaged(spark, folder, VECTORS) if seeds is None else seeds.select("id", "content_hash", "fingerprint", F.col("values").cast("array<double>").alias("values"))
    known = known.withColumn("ok", F.coalesce((F.col("fingerprint") == fingerprint) & finite(F.col("values"), dimensions) & nonzero(F.col("values")), F.lit(False)))
    status = changes(chunks.select("id", "content_hash"), known.select("id", "content_hash", "ok"))
    reused = known.join(status.filter("status = 'reused'").select("id"), "id", "left_semi")
    todo = chunks.join(status.filter("status IN ('added', 'updated')").select("id"), "id", "left_semi")
    built = build(todo).select("id", F.col("values").cast("array<double>").alias("values")).join(todo.select("id", "content_hash"), "id").withColumn("fingerprint", F.lit(fingerprint))
    columns = ["id", "content_hash", "fingerprint", "values"]
    stage(reused.select(columns).unionByName(built.select(columns)), folder, version)
    staged = undamaged(spark, folder, VECTORS, version)  # what was written, not what was meant
    state = completeness(chunks, staged).first().asDict()
    double = staged.groupBy("id").count().filter("count > 1").count()
    wrong = staged.filter(~F.coalesce(finite(F.col("values"), dimensions), F.lit(False))).count()
    counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    report = {k: counts.get(k, 0) for k in ("added", "updated", "reused", "deleted")} | state | {"repeated": double, "malformed": wrong, "version": version, "published": False}
    if state["complete"] and not double and not wrong:
        point(folder, version)
        report["published"] = True
    return report
