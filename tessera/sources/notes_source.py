"""Folders of notes as a Spark data source: `spark.read.format("notes")`, and their changes as a stream.

Batch: a row for each file below `path`.  The files are listed once, where the query is
planned, and dealt to partitions by size; their contents are read by the tasks.
Filters on path, suffix and mtime are taken over (Spark leaves them out then), so files
that they exclude are not opened; reading without the column content opens none at all
when `contents` is "false".

Stream: a row for each file that was added, changed or removed since the batch before.
A file stream of Spark never tells of removals; here an offset names a listing, which is
kept as a file in the folder `state`, and a batch is the difference of two listings.  So
a restart goes on where it stopped, and a batch that is tried again gives the same rows.

Both go through Arrow's file systems, so a path may be local or of another store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

#: Bytes of the files of a partition, and changed files of a partition of the stream.
PARTITION_BYTES, PARTITION_FILES = 32 * 1024 * 1024, 10_000
BATCH = "path string, suffix string, mtime double, length long, content binary"
CHANGES = "path string, change string, mtime double, length long"
_TESTS = {
    EqualTo: lambda a, b: a == b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    In: lambda a, b: a in b,
    StringStartsWith: lambda a, b: a.startswith(b),
    StringEndsWith: lambda a, b: a.endswith(b),
    StringContains: lambda a, b: b in a,
    IsNotNull: lambda a, b: a is not None,
}


def _store(path: str):  # noqa: ANN202
    """The file system of a path, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def listing(root: str) -> list[tuple[str, float, int]]:
    """(path, mtime, length) of the files below a root, without hidden files and folders, by path."""
    from pyarrow import fs

    store, base = _store(root.rstrip("/"))
    found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    shown = [f for f in found if f.type == fs.FileType.File and not any(p.startswith(".") for p in f.path[len(base) :].split("/"))]
    return sorted((f.path, f.mtime_ns / 1e9 if f.mtime_ns else 0.0, f.size) for f in shown)


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return f".{name.rsplit('.', 1)[1].lower()}" if "." in name[1:] else ""


@dataclass
class Files(InputPartition):
    files: list[tuple[str, float, int]]


class NotesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.contents = options["path"], str(options.get("contents", "true")).lower() != "false"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Take what only needs the listing; the rest is Spark's to apply."""
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("path",), ("suffix",), ("mtime",)):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, file: tuple[str, float, int]) -> bool:
        value = {("path",): file[0], ("suffix",): suffix_of(file[0]), ("mtime",): file[1]}
        return all(_TESTS[type(f)](value[f.attribute], getattr(f, "value", None)) for f in self.filters)

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for file in filter(self._wanted, listing(self.root)):
            if out[-1].files and (size + file[2] > PARTITION_BYTES or len(out[-1].files) >= PARTITION_FILES):
                out.append(Files([]))
                size = 0
            out[-1].files.append(file)
            size += file[2]
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _store(self.root)
        for path, mtime, length in partition.files:
            content = None
            if self.contents:
                try:
                    with store.open_input_stream(path) as f:
                        content = f.read()
                except FileNotFoundError:  # it went after the listing
                    continue
            yield path, suffix_of(path), mtime, length, content


class NotesChanges(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.state = options["path"], options["state"].rstrip("/")

    def _save(self, files: list[tuple[str, float, int]]) -> str:
        store, base = _store(self.state)
        store.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{base}/{name}.tmp") as f:
            f.write("".join(json.dumps(x) + "\n" for x in files).encode())
        store.move(f"{base}/{name}.tmp", f"{base}/{name}.jsonl")
        return name

    def _load(self, offset: dict) -> dict[str, tuple[float, int]]:
        if not offset.get("listing"):
            return {}
        store, base = _store(self.state)
        with store.open_input_stream(f"{base}/{offset['listing']}.jsonl") as f:
            return {path: (mtime, length) for path, mtime, length in map(json.loads, f.read().decode().splitlines())}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        """A new listing, or the last one if nothing has changed."""
        now = listing(self.root)
        last = getattr(self, "_last", None)
        if last is None or last[1] != now:
            self._last = last = (self._save(now), now)
        return {"listing": last[0]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        old, new = self._load(start), self._load(end)
        rows = [(p, "added" if p not in old else "changed", *new[p]) for p in sorted(new) if old.get(p) != new[p]]
        rows += [(p, "removed", *old[p]) for p in sorted(set(old) - set(new))]
        return [Files(rows[i : i + PARTITION_FILES]) for i in range(0, len(rows), PARTITION_FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from partition.files

    def commit(self, end: dict) -> None:
        """Listings before the last committed one are not needed any more; it and its forerunner stay."""
        from pyarrow import fs

        store, base = _store(self.state)
        keep = {f"{end.get('listing')}.jsonl", f"{getattr(self, '_committed', '')}.jsonl", f"{getattr(self, '_last', ('',))[0]}.jsonl"}
        if getattr(self, "_committed", None):  # after a restart the first commit removes nothing
            for f in store.get_file_info(fs.FileSelector(base)):
                if f.base_name.endswith(".jsonl") and f.base_name not in keep:
                    store.delete_file(f.path)
        self._committed = end.get("listing")


class NotesSource(DataSource):
    """Options: path; batch: contents ("false" leaves content null); stream: state, a folder of the reader's own."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return CHANGES if "state" in self.options else BATCH

    def reader(self, schema) -> NotesReader:  # noqa: ANN001
        return NotesReader(dict(self.options))

    def streamReader(self, schema) -> NotesChanges:  # noqa: ANN001, N802
        return NotesChanges(dict(self.options))


def register(spark) -> None:  # noqa: ANN001
    """Make the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NotesSource)
