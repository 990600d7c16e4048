"""The Python data source `dicom`: files of a folder as element rows, batch or stream, and files written in two phases.

`register(spark)` makes it known to a session and lets Spark push filters to it.

- Batch: `spark.read.format("dicom").load(uri)`. Equality and IN on `tag` become the tags that are parsed, equality, IN and prefixes on `file` choose the
  files that are listed, whatever else is asked. Option `tags` (hexadecimal, comma-separated) does the same by hand.
- Stream: `spark.readStream.format("dicom").option("log", uri).load(uri)`. Each trigger plans a batch: the files that no earlier batch has are written to
  the log under the batch's number, which is the offset. A batch that is run again reads the files its log entry names, so every file comes once.
- Writing: rows of (name, content). A task writes its files below `_temporary`, and Spark's commit moves each task's folder into place by one rename,
  so the driver's work and messages grow with tasks, not with files. A failed job leaves nothing but what it found.

A task's folder (part-<id>) holds folders of at most `CHUNK` files, numbered from 0. Nothing is added to them once they are committed, so the driver
lists, logs and deals them whole (a path that ends with /), and tasks list what is in them. Files elsewhere are listed one by one; so are all where
filters choose files, or maxFilesPerTrigger or filesPerPartition counts them.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from tessera.sources import part10

STAGING, DONE = "_temporary", "_SUCCESS"
#: Files in a folder that is listed, logged and dealt whole.
CHUNK = 1024


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DicomDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def listed(folder: str) -> list[str]:
    """Paths of the committed .dcm files of a folder, in order; none where there is no folder."""
    system, root = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(i.path for i in found if i.is_file and i.path.endswith(".dcm") and f"/{STAGING}/" not in i.path)


def units(folder: str) -> list[str]:
    """What `listed` gives, in order, with each chunk of the writer's as the path of its folder and a /: as many entries as there are chunks and other files."""
    system, root = fs.FileSystem.from_uri(folder)
    out, open_ = [], [root]
    while open_:
        at = open_.pop()
        committed = re.search(r"/part-[0-9a-f]{32}$", at)
        for i in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if i.type != fs.FileType.Directory:
                out += [i.path] if i.is_file and i.path.endswith(".dcm") else []
            elif committed and i.base_name.isdecimal():
                out.append(f"{i.path}/")
            elif i.base_name != STAGING:
                open_.append(i.path)
    return sorted(out)


def files_in(system: fs.FileSystem, paths: list[str]) -> Iterator[str]:
    """Paths of files, chunks being listed one at a time."""
    for path in paths:
        if path.endswith("/"):
            yield from sorted(i.path for i in system.get_file_info(fs.FileSelector(path[:-1])) if i.is_file and i.path.endswith(".dcm"))
        else:
            yield path


@dataclass
class FilePart(InputPartition):
    paths: list[str]


def parts(paths: list[str], size: int) -> list[FilePart]:
    """Partitions of `size` files; where it is 0 of as many as give 256 partitions, but from 64 to 4096: a task costs as much as hundreds of small
    files. A chunk counts as full."""
    weights = [CHUNK if p.endswith("/") else 1 for p in paths]
    size = size or min(max(sum(weights) // 256, 64), 4096)
    out, held = [FilePart([])], 0
    for path, weight in zip(paths, weights, strict=True):
        if held and held + weight > size:
            out.append(FilePart([]))
            held = 0
        out[-1].paths.append(path)
        held += weight
    return out


def read_files(folder: str, paths: list[str], tags: frozenset[int] | None) -> Iterator[pa.RecordBatch]:
    """Element rows of the files, read one at a time; a batch has those of many files."""
    system, _ = fs.FileSystem.from_uri(folder)

    def content(path: str) -> bytes:
        with system.open_input_stream(path) as file:
            return file.read()

    return part10.parse_files(tags)((path, content(path)) for path in files_in(system, paths))


def told_tags(options: dict) -> frozenset[int] | None:
    return frozenset(int(t, 16) for t in options["tags"].split(",")) if options.get("tags") else None


class DicomReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.size, self.tags = options["path"], int(options.get("filesPerPartition", "0")), told_tags(options)
        self.files: frozenset[str] | None = None
        self.only: frozenset[int] | None = None
        self.prefixes: list[str] = []

    def pushFilters(self, filters):
        """Narrows what is listed, parsed and given out; Spark is left with the other filters."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if isinstance(f, EqualTo | In) and column in (("tag",), ("file",)):
                values = frozenset([f.value] if isinstance(f, EqualTo) else f.value) - {None}
                if column == ("tag",):
                    self.only = values if self.only is None else self.only & values
                else:
                    self.files = values if self.files is None else self.files & values
            elif isinstance(f, StringStartsWith) and column == ("file",):
                self.prefixes.append(f.value)
            else:
                yield f

    def partitions(self):
        if self.size or self.files is not None or self.prefixes:
            return parts([p for p in listed(self.folder) if (self.files is None or p in self.files) and all(p.startswith(x) for x in self.prefixes)], self.size)
        return parts(units(self.folder), 0)

    def read(self, partition: FilePart):
        if self.only is None:
            return read_files(self.folder, partition.paths, self.tags)
        # sequences and their items are parsed beside the tags asked for
        only = pa.array(sorted(self.only), pa.int64())
        batches = read_files(self.folder, partition.paths, self.only if self.tags is None else self.tags & self.only)
        return (batch.filter(pc.is_in(batch.column("tag"), value_set=only)) for batch in batches)


class DicomStreamReader(DataSourceStreamReader):
    """Offsets are numbers of planned batches; entry n of the log, one small file, names the files and chunks of batch n."""

    def __init__(self, options: dict):
        if not options.get("log"):
            raise ValueError("a stream of dicom files needs the option log: a folder that outlives the query and that nothing else uses")
        self.folder, self.log, self.tags = options["path"], options["log"], told_tags(options)
        self.size, self.most = int(options.get("filesPerPartition", "0")), int(options.get("maxFilesPerTrigger", "0"))
        self.seen: set[str] | None = None
        self.planned = 0

    def _entry(self, n: int) -> list[str]:
        system, root = fs.FileSystem.from_uri(self.log)
        with system.open_input_stream(f"{root}/{n}.json") as file:
            return json.loads(file.read())

    def _load(self) -> None:
        system, root = fs.FileSystem.from_uri(self.log)
        system.create_dir(root)
        numbers = sorted(int(i.base_name[:-5]) for i in system.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".json"))
        self.planned = numbers[-1] if numbers else 0
        self.seen = {p for n in numbers for p in self._entry(n)}

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        if self.seen is None:
            self._load()
        new = self._new()
        new = new[: self.most] if self.most else new
        if new:
            system, root = fs.FileSystem.from_uri(self.log)
            part = f"{root}/.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(json.dumps(new).encode())
            system.move(part, f"{root}/{self.planned + 1}.json")
            self.planned += 1
            self.seen.update(new)
        return {"batch": self.planned}

    def _new(self) -> list[str]:
        """Files, and chunks where files aren't counted, that no batch has. An earlier run may have counted: of a chunk it has files of, the others are new."""
        chunk = lambda path: path.rpartition("/")[0] + "/"
        if self.most or self.size:
            return [p for p in listed(self.folder) if p not in self.seen and chunk(p) not in self.seen]
        system, _ = fs.FileSystem.from_uri(self.folder)
        begun = {chunk(p) for p in self.seen if not p.endswith("/")}
        own = (q for p in units(self.folder) if p not in self.seen for q in (files_in(system, [p]) if p in begun else [p]))
        return [p for p in own if p not in self.seen]

    def partitions(self, start: dict, end: dict):
        return parts([p for n in range(start["batch"] + 1, end["batch"] + 1) for p in self._entry(n)], self.size)

    def read(self, partition: FilePart):
        return read_files(self.folder, partition.paths, self.tags)


@dataclass
class Written(WriterCommitMessage):
    folder: str | None


class DicomWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        if sorted(names) != ["content", "name"]:
            raise ValueError("files are written from rows of name and content")
        self.folder, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.at = [names.index("name"), names.index("content")]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = fs.FileSystem.from_uri(self.folder)
        own, names = f"part-{uuid.uuid4().hex}", set()
        target = f"{root}/{STAGING}/{self.job}/{own}"
        for batch in iterator:
            for name, content in zip(batch.column(self.at[0]).to_pylist(), batch.column(self.at[1]), strict=True):
                if not name or "/" in name or name.startswith(".") or name in names:
                    raise ValueError(f"no name for a file of its own: {name!r}")
                if not names:
                    system.create_dir(target, recursive=False)  # fails where the job was aborted: a task that still runs then leaves nothing
                chunk = f"{target}/{len(names) // CHUNK}"
                if len(names) % CHUNK == 0:
                    system.create_dir(chunk, recursive=False)
                names.add(name)
                with system.open_output_stream(f"{chunk}/{name}") as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
        return Written(own if names else None)

    def commit(self, messages) -> None:
        system, root = fs.FileSystem.from_uri(self.folder)
        system.create_dir(root)
        old = [i for i in system.get_file_info(fs.FileSelector(root)) if i.base_name != STAGING] if self.overwrite else []
        for m in messages:
            if m and m.folder:
                system.move(f"{root}/{STAGING}/{self.job}/{m.folder}", f"{root}/{m.folder}")
        for i in old:
            system.delete_dir(i.path) if i.type == fs.FileType.Directory else system.delete_file(i.path)
        self._clear()
        with system.open_output_stream(f"{root}/{DONE}") as out:
            out.write(b"")

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        """Takes away what the job has staged, and the staging folder where no other job writes."""
        system, root = fs.FileSystem.from_uri(self.folder)
        own = f"{root}/{STAGING}/{self.job}"
        for _ in range(10):
            try:
                if system.get_file_info(own).type != fs.FileType.Directory:
                    break
                system.delete_dir(own)
            except OSError:  # a task that still runs put a file there meanwhile
                time.sleep(0.2)
        if system.get_file_info(f"{root}/{STAGING}").type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(f"{root}/{STAGING}")):
            system.delete_dir(f"{root}/{STAGING}")


class DicomDataSource(DataSource):
    """spark.read.format("dicom").load(uri), spark.readStream..., df.write.format("dicom").mode("append").save(uri)"""

    @classmethod
    def name(cls) -> str:
        return "dicom"

    def schema(self) -> str:
        return part10.ELEMENTS

    def reader(self, schema) -> DicomReader:
        return DicomReader(self.options)

    def streamReader(self, schema) -> DicomStreamReader:
        return DicomStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DicomWriter:
        out = DicomWriter(self.options, schema.names, overwrite)
        system, root = fs.FileSystem.from_uri(out.folder)
        system.create_dir(f"{root}/{STAGING}/{out.job}")
        return out
