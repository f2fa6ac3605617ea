"""Data sources of the evaluation format: samples with their ground truth by manifest, and one JSON array as a sink.

Both run in Python workers, where paths go through pyarrow's file systems: local and shared folders, HDFS, object stores.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from tallyform.sources import io

#: Samples whose ground truth one task reads.
SAMPLES_A_TASK = 256

_SAMPLE = [c.split()[0] for c in io.SAMPLE.split(", ")]


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain local path."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path.split(":", 1)[1] if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def _read_json(path: str) -> dict:
    system, at = _located(path)
    with system.open_input_stream(at) as f:
        return json.loads(f.read())


@dataclass
class _Samples(InputPartition):
    rows: tuple[dict, ...]


class _ManifestReader(DataSourceReader):
    """Plans tasks from the manifest, so ground truth is opened for wanted samples alone."""

    def __init__(self, manifest: str, expected: str) -> None:
        self.manifest, self.expected = manifest, expected
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what can be told from the manifest; Spark filters by the rest."""
        for f in filters:
            known = isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in _SAMPLE and f.attribute[0] != "tags"
            if known:
                self.wanted.append(f)
            else:
                yield f

    def _wants(self, sample: dict) -> bool:
        for f in self.wanted:
            x = sample.get(f.attribute[0])
            if isinstance(f, IsNotNull):
                ok = x is not None
            elif isinstance(f, EqualTo):
                ok = x is not None and x == f.value
            elif isinstance(f, StringStartsWith):
                ok = x is not None and x.startswith(f.value)
            else:
                ok = x is not None and x in f.value
            if not ok:
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        found = _read_json(self.manifest).get("samples") or []
        rows = [s | {"capture_condition": s.get("capture_condition") or "clean"} for s in found]
        rows = [s for s in rows if self._wants(s)]
        return [_Samples(tuple(rows[a : a + SAMPLES_A_TASK])) for a in range(0, max(len(rows), 1), SAMPLES_A_TASK)]

    def read(self, partition: _Samples) -> Iterator[tuple]:
        for s in partition.rows:
            try:
                truth = _read_json(f"{self.expected}/{s['sample_id']}.json")
            except FileNotFoundError:
                truth = None
            got = truth or {}
            yield (*(s.get(c) for c in _SAMPLE), truth is not None, got.get("fields"), got.get("required_fields"), got.get("portrait_present"), got.get("portrait_bbox"))


class ManifestSource(DataSource):
    """spark.read.format("evaluation_manifest").option("expected", folder).load(manifest): a row a sample with its ground truth.

    Columns are those of a sample, has_expected, and fields, required_fields, portrait_present and portrait_bbox of the
    ground truth, null where its file is missing. Equality, IN, prefixes and IS NOT NULL on a sample's own columns are
    answered from the manifest where spark.sql.python.filterPushdown.enabled is set.
    """

    @classmethod
    def name(cls) -> str:
        return "evaluation_manifest"

    def schema(self) -> str:
        return f"{io.SAMPLE}, has_expected boolean, fields map<string,string>, required_fields array<string>, portrait_present boolean, portrait_bbox array<int>"

    def reader(self, schema: StructType) -> _ManifestReader:
        return _ManifestReader(self.options["path"], self.options["expected"])


def read_samples(spark: SparkSession, manifest: str, expected: str) -> DataFrame:
    """Samples of one manifest with their ground truth; turns filter push-down into Python sources on for the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ManifestSource)
    return spark.read.format(ManifestSource.name()).option("expected", expected).load(manifest)


def write_expected(expected: DataFrame, folder: str) -> None:
    """One <sample_id>.json a row; a task that runs again writes the same files."""

    def put(rows: Iterator) -> None:
        system, at = _located(folder)
        system.create_dir(at, recursive=True)
        for r in rows:
            with system.open_output_stream(f"{at}/{r.sample_id}.json") as f:
                f.write(r.j.encode())

    expected.select("sample_id", F.to_json(F.struct("*")).alias("j")).foreachPartition(put)


# ---------------------------------------------------------------- JSON array


@dataclass
class _Part(WriterCommitMessage):
    number: int
    path: str
    rows: int


class _ArrayWriter(DataSourceArrowWriter):
    """Tasks write their rows beside the target; the commit joins the parts in order and moves the whole into place."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.folder = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        from pyspark import TaskContext

        system, folder = _located(self.folder)
        system.create_dir(folder, recursive=True)
        task = TaskContext.get()
        path, rows = f"{folder}/{task.partitionId()}-{task.attemptNumber()}-{uuid.uuid4().hex}", 0
        with system.open_output_stream(path) as f:
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    f.write(((",\n" if rows else "") + line).encode("utf-8", "surrogatepass"))
                    rows += 1
        return _Part(task.partitionId(), path, rows)

    def commit(self, messages: list[_Part | None]) -> None:
        system, target = _located(self.path)
        _, folder = _located(self.folder)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/whole") as out:
            out.write(b"[")
            lead = b"\n"
            for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number):
                out.write(lead)
                lead = b",\n"
                with system.open_input_stream(part.path) as f:
                    while block := f.read(1 << 20):
                        out.write(block)
            out.write(b"\n]\n")
        system.move(f"{folder}/whole", target)
        system.delete_dir(folder)

    def abort(self, messages: list[_Part | None]) -> None:
        system, folder = _located(self.folder)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class ArraySink(DataSource):
    """df.write.format("json_array").mode("overwrite").save(file): one text column, a JSON value a row, as one JSON array in row order."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> _ArrayWriter:
        return _ArrayWriter(self.options["path"])


def write_array(rows: DataFrame, path: str) -> None:
    """rows as one JSON array in one file, objects with all keys. Tasks write it; the driver only joins files."""
    rows.sparkSession.dataSource.register(ArraySink)
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.format(ArraySink.name()).mode("overwrite").save(path)
