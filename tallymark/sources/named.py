"""Files named by a column, written by tasks and put in place by one commit.

A sink for what has to be a file of its own: a report a group, a draft a message, an array a part. Spark's writers name
files themselves. Each task attempt writes into a folder of its own below ``_attempts``; only the folders of attempts that
succeeded are moved into place when all have, so that a task that is tried again, or a job that fails, leaves no file and no half of one.
Files of the same name are replaced, others stay.

A file takes a block of the file system at least, however short it is. Where there are millions, ``write_packed`` puts them
into archives of bounded size, in the same way.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "named_files"
ATTEMPTS = "_attempts"
ARCHIVE = ".tar.gz"
#: Bytes of files in an archive, about: a task that reads one holds so much.
PACKED = 1 << 25


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def checked(name: str | None) -> str:
    """A file name; ValueError for one that is none or leads elsewhere."""
    if not name or name in (".", "..") or name.startswith("_") or any(c in name for c in "/\\\0"):
        raise ValueError(f"not a file name: {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    folder: str
    n_files: int


class NamedWriter(DataSourceWriter):
    """Rows (name, value), those of a name together and in order; the values of a name are its file."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        system, base = _system(self.path)
        folder = f"{base}/{ATTEMPTS}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        now, stream, done = None, None, 0
        try:
            for row in iterator:
                name, value = row[0], row[1]
                if stream is None or name != now:
                    if stream is not None:
                        stream.close()
                    target = f"{folder}/{checked(name)}"
                    if system.get_file_info(target).is_file:
                        raise ValueError(f"rows of {name!r} are not together")
                    now, stream, done = name, system.open_output_stream(target), done + 1
                stream.write((value or "").encode("utf-8", "surrogatepass"))
        finally:
            if stream is not None:
                stream.close()
        return Written(folder, done)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, base = _system(self.path)
        for message in messages:
            if message is not None and message.n_files:
                for found in system.get_file_info(fs.FileSelector(message.folder)):
                    system.move(found.path, f"{base}/{found.base_name}")
        self._clear(system, base)
        system.open_output_stream(f"{base}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_system(self.path))

    def _clear(self, system, base: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{base}/{ATTEMPTS}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{ATTEMPTS}/{self.job}")


class PackedWriter(NamedWriter):
    """The same files as members of archives, each archive written as a stream by one task."""

    def write(self, iterator: Iterator) -> Written:
        import io
        import itertools
        import tarfile

        system, base = _system(self.path)
        folder = f"{base}/{ATTEMPTS}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        stream, archive, held, done, seen = None, None, 0, 0, None
        try:
            for name, rows in itertools.groupby(iterator, key=lambda row: row[0]):
                if archive is None:
                    stream = system.open_output_stream(f"{folder}/{uuid.uuid4().hex}{ARCHIVE}", compression=None)
                    archive, held, done = tarfile.open(fileobj=stream, mode="w|gz"), 0, done + 1
                value = b"".join((row[1] or "").encode("utf-8", "surrogatepass") for row in rows)
                if seen is not None and checked(name) <= seen:
                    raise ValueError(f"rows of {name!r} are not together")
                seen = checked(name)
                member = tarfile.TarInfo(seen)
                member.size = len(value)
                archive.addfile(member, io.BytesIO(value))
                held += len(value) + tarfile.BLOCKSIZE
                if held >= PACKED:
                    archive.close()
                    stream.close()
                    stream = archive = None
            if archive is not None:
                archive.close()
        finally:
            if stream is not None:
                stream.close()
        return Written(folder, done)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite: bool) -> NamedWriter:
        if "path" not in self.options:
            raise ValueError("a path is needed")
        return (PackedWriter if self.options.get("packed") == "true" else NamedWriter)(self.options["path"])


def _save(rows: DataFrame, folder: str, packed: bool = False) -> None:
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.write.format(FORMAT).mode("append").option("path", folder).option("packed", str(packed).lower()).save()


def _together(rows: DataFrame, name: str, value: str, order: tuple[str, ...]) -> DataFrame:
    told = rows.select(F.col(name).alias("__name"), F.col(value).alias("__value"), *order)
    return told.repartition("__name").sortWithinPartitions("__name", *order).select(F.col("__name").alias("name"), F.col("__value").alias("value"))


def write(rows: DataFrame, folder: str, name: str, value: str, order: tuple[str, ...] = ()) -> None:
    """A file for each name, of its values in ``order``. A file is written by one task, as a stream."""
    _save(_together(rows, name, value, order), folder)


def write_packed(rows: DataFrame, folder: str, name: str, value: str, order: tuple[str, ...] = ()) -> None:
    """The files of ``write`` in archives, which ``tar`` unpacks; the folder must hold none yet. A task holds one file at a time."""
    from pyarrow import fs

    system, base = _system(folder)
    if any(f.base_name.endswith(ARCHIVE) for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True))):
        raise ValueError(f"there are archives in {folder} already")
    _save(_together(rows, name, value, order), folder, packed=True)


def write_arrays(rows: DataFrame, folder: str) -> None:
    """Each part of ``rows`` as a file with one JSON array, null fields included; an empty part is an empty array."""

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        name, first = f"part-{TaskContext.get().partitionId():05}.json", True
        for batch in batches:
            values = batch.column(0).to_pylist()
            if values:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values)), pa.array([("[" if first and i == 0 else ",\n") + v for i, v in enumerate(values)])], ["name", "value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array(["[]\n" if first else "]\n"])], ["name", "value"])

    told = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    _save(told.mapInArrow(work, "name string, value string"), folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(name, value): the files of a folder, each whole."""
    found = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/\\]*)$", 1).alias("name"), "value")
    return found.select(F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B"))).alias("name"), "value")


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """(name, value): the files in the archives of a folder, each whole."""

    def work(batches):
        import io
        import tarfile

        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                names, values, held = [], [], 0
                with tarfile.open(fileobj=io.BytesIO(content.as_py()), mode="r|gz") as archive:
                    for member in archive:
                        value = archive.extractfile(member).read()
                        archive.members = []  # else the headers of all are kept
                        names.append(member.name)
                        values.append(value.decode("utf-8"))
                        held += len(value)
                        if len(names) >= 4096 or held >= 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], ["name", "value"])
                            names, values, held = [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], ["name", "value"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ARCHIVE}").load(folder)
    return found.select("content").mapInArrow(work, "name string, value string")
