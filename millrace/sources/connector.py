"""A connector in Python for Parquet folders with commits: all of Spark's protocol for sources and sinks, in batches and streams.

Files become visible by a commit, a small manifest that names them, so a write is seen whole or not at all; a folder
without commits is read as its Parquet files in the order of their age. Reads have a partition for each row group, and filters that Spark hands
over skip row groups by their statistics and rows by the filter itself.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from millrace.plans.catalog import register
from millrace.sources.scratch import scratch, stored
from millrace.sources.tables import SCHEMAS, table

COMMITS = "_commits"


class Folder:
    """A folder of a file system that pyarrow knows: local, hdfs, s3, gs."""

    def __init__(self, path: str) -> None:
        # file:/x and file:///x are the same place
        self.fs, self.root = fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path) if ":/" in path else (fs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")

    def listed(self, name: str = "") -> list[fs.FileInfo]:
        return self.fs.get_file_info(fs.FileSelector(f"{self.root}/{name}".rstrip("/"), allow_not_found=True))

    def commits(self) -> list[dict]:
        """All manifests, in their order."""
        names = sorted(i.path for i in self.listed(COMMITS) if i.path.endswith(".json"))
        out = []
        for name in names:
            with self.fs.open_input_stream(name) as f:
                out.append(json.loads(f.read()))
        return out

    def files(self) -> list[str]:
        """Visible files, in the order of their commits; without commits in the order of their age."""
        found: list[str] = []
        commits = self.commits()
        for commit in commits:
            found = ([] if commit["replace"] else found) + [f"{self.root}/{f}" for f in commit["files"]]
        if commits:
            return found
        one = self.fs.get_file_info(self.root)
        if one.type == fs.FileType.File:
            return [self.root]
        plain = [i for i in self.listed() if i.type == fs.FileType.File and i.path.endswith(".parquet") and i.base_name[0] not in "._"]
        return [i.path for i in sorted(plain, key=lambda i: (i.mtime_ns or 0, i.path))]

    def commit(self, files: list[str], replace: bool, number: int | None = None) -> None:
        """Make files visible together. A stream's batch has a number, so that a repeated one changes nothing."""
        self.fs.create_dir(f"{self.root}/{COMMITS}", recursive=True)
        name = f"stream-{number:020d}" if number is not None else f"{len(self.listed(COMMITS)):020d}"
        place = f"{self.root}/{COMMITS}/{name}.json"
        if number is not None and self.fs.get_file_info(place).type == fs.FileType.File:
            return
        draft = f"{self.root}/{COMMITS}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps({"files": sorted(files), "replace": replace}).encode())
        self.fs.move(draft, place)

    def delete(self, files: list[str]) -> None:
        for name in files:
            if self.fs.get_file_info(f"{self.root}/{name}").type == fs.FileType.File:
                self.fs.delete_file(f"{self.root}/{name}")


#: Filters that the reader applies: the comparison in pyarrow, and whether a row group with these least and largest values may have rows.
COMPARISONS = {
    "EqualTo": (pc.equal, lambda v, lo, hi: lo <= v <= hi),
    "GreaterThan": (pc.greater, lambda v, lo, hi: hi > v),
    "GreaterThanOrEqual": (pc.greater_equal, lambda v, lo, hi: hi >= v),
    "LessThan": (pc.less, lambda v, lo, hi: lo < v),
    "LessThanOrEqual": (pc.less_equal, lambda v, lo, hi: lo <= v),
}


@dataclass
class RowGroup(ds.InputPartition):
    file: str
    group: int


class Reader(ds.DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema, self.filters = path, to_arrow_schema(schema), []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Take the comparisons of whole columns with values; give the others back to Spark."""
        for f in filters:
            kind = type(f).__name__
            fine = len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in self.schema.names
            if fine and kind in COMPARISONS and f.value is not None and f.value == f.value:
                self.filters.append((kind, f.attribute[0], f.value))
            elif fine and kind in ("IsNotNull", "IsNull"):
                self.filters.append((kind, f.attribute[0], None))
            else:
                yield f

    def partitions(self) -> list[ds.InputPartition]:
        folder = Folder(self.path)
        return [RowGroup(f, g) for f in folder.files() for g in groups(folder, f, self.filters)]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # Spark asks once with none where there are no partitions
            yield from batches(Folder(self.path), partition, self.schema, self.filters)


def groups(folder: Folder, file: str, filters: list[tuple]) -> list[int]:
    """The row groups of a file that may have rows, by the statistics in its footer."""
    with folder.fs.open_input_file(file) as f:
        meta = pq.ParquetFile(f).metadata
    place = {meta.schema.column(c).path: c for c in range(meta.num_columns)}

    def may_have(g: int) -> bool:
        for kind, name, value in filters:
            stats = meta.row_group(g).column(place[name]).statistics if name in place else None
            if stats is None:
                continue
            if kind in COMPARISONS and stats.has_min_max and not COMPARISONS[kind][1](value, stats.min, stats.max):
                return False
            if kind == "IsNull" and stats.has_null_count and not stats.null_count:
                return False
        return True

    return [g for g in range(meta.num_row_groups) if may_have(g)]


def batches(folder: Folder, part: RowGroup, schema: pa.Schema, filters: list[tuple]) -> Iterator[pa.RecordBatch]:
    with folder.fs.open_input_file(part.file) as f:
        for batch in pq.ParquetFile(f).iter_batches(10_000, [part.group], columns=schema.names):
            keep = None
            for kind, name, value in filters:
                column = batch.column(name)
                if kind in COMPARISONS:
                    mask = pc.fill_null(COMPARISONS[kind][0](column, pa.scalar(value, column.type)), False)
                else:
                    mask = pc.is_null(column) if kind == "IsNull" else pc.is_valid(column)
                keep = mask if keep is None else pc.and_(keep, mask)
            batch = batch if keep is None else batch.filter(keep)
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(n).cast(schema.field(n).type) for n in schema.names], schema=schema)


class StreamReader(ds.DataSourceStreamReader):
    """Offsets are numbers of visible files, which only grow as commits come."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, to_arrow_schema(schema)

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(Folder(self.path).files())}

    def partitions(self, start: dict, end: dict) -> list[ds.InputPartition]:
        folder = Folder(self.path)
        return [RowGroup(f, g) for f in folder.files()[start["files"] : end["files"]] for g in groups(folder, f, [])]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        yield from batches(Folder(self.path), partition, self.schema, [])

    def commit(self, end: dict) -> None:
        """Files stay, as others may read them."""


@dataclass
class Written(ds.WriterCommitMessage):
    files: list


class Sink:
    """What both writers share: a task writes one file that no commit names yet."""

    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite = path, to_arrow_schema(schema), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, name, out = Folder(self.path), f"part-{uuid.uuid4().hex}.parquet", None
        folder.fs.create_dir(folder.root, recursive=True)
        try:
            for batch in iterator:
                if out is None:
                    out = pq.ParquetWriter(f"{folder.root}/{name}", self.schema, filesystem=folder.fs)
                out.write_table(pa.Table.from_batches([batch]).cast(self.schema))
        except BaseException:
            if out is not None:
                out.close()
                folder.delete([name])
            raise
        if out is None:
            return Written([])
        out.close()
        return Written([name])

    def gone(self, messages: list) -> None:
        Folder(self.path).delete([f for m in messages if m is not None for f in m.files])


class Writer(Sink, ds.DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        Folder(self.path).commit([f for m in messages if m is not None for f in m.files], self.overwrite)

    def abort(self, messages: list) -> None:
        self.gone(messages)


class StreamWriter(Sink, ds.DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        Folder(self.path).commit([f for m in messages if m is not None for f in m.files], False, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self.gone(messages)


class CommittedParquet(ds.DataSource):
    """format("millrace_parquet"): the option path is a folder, or one file to read."""

    @classmethod
    def name(cls) -> str:
        return "millrace_parquet"

    def schema(self) -> StructType:
        folder = Folder(self.options["path"])
        files = folder.files()
        if not files:
            raise ValueError(f"no visible file in {self.options['path']}: give a schema")
        with folder.fs.open_input_file(files[0]) as f:
            return from_arrow_schema(pq.ParquetFile(f).schema_arrow, prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"], schema, overwrite)


def connected(spark: SparkSession) -> SparkSession:
    """The session with the connector, and with filters handed to Python sources."""
    spark.dataSource.register(CommittedParquet)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


@register("scan_custom", "SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click' AND value > 20 AND user_id % 2 = 0")
def scan_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written through the connector and read back with its inferred schema and pushed filters; the third one stays with Spark."""
    path = scratch(connected(spark), "custom")
    table(spark, sf_dir, "events").repartitionByRange(4, "event_id").write.format("millrace_parquet").mode("append").save(path)
    rows = spark.read.format("millrace_parquet").load(path)
    return rows.where("event_type = 'click' AND value > 20 AND user_id % 2 = 0").select("event_id", "user_id", "ts", "value")


@register("stream_custom", "SELECT event_id, event_type FROM events WHERE event_type <> 'view'")
def stream_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connector as a stream's source and sink: events come in three commits, and each batch is one commit of the other folder."""
    source, sink = scratch(connected(spark), "custom-in"), scratch(spark, "custom-out")
    events = stored(table(spark, sf_dir, "events"), "custom-events")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(2).write.format("millrace_parquet").mode("append").save(source)
    stream = spark.readStream.format("millrace_parquet").schema(SCHEMAS["events"]).load(source)
    kept = stream.where("event_type <> 'view'").select("event_id", "event_type")
    kept.writeStream.format("millrace_parquet").option("path", sink).option("checkpointLocation", f"{sink}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.format("millrace_parquet").schema("event_id long, event_type string").load(sink)
