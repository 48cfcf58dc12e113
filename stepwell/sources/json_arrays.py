"""Files that hold one JSON array each, read by byte ranges and written by tasks.

``json_arrays`` is a Python data source.  A file is cut into ranges of ``split_bytes``
and a range is a partition, so one large array is read by many tasks.  Where an
element begins cannot be seen from a range alone: a comma counts only outside of
strings and at the array's own depth.  So reading takes two passes over the bytes:

1. ``parity`` mode.  A range is a map of three states (outside a string, inside one,
   behind a backslash inside one): for each it says the state at its end and by how
   much the depth of brackets has changed.  Runs of backslashes and quotes are
   counted by prefix sums; no byte is looked at alone.
2. The maps of a file's ranges are composed in order, a few numbers for each range,
   which gives the state and depth that each begins with.
3. ``elements`` mode.  With these a range finds the borders of elements exactly, owns
   the elements that begin inside it, and reads on to the end of its last one.

Written arrays are one file for each task; a task's file gets its name only when it
is whole, and a failed attempt leaves none.

Defined cases: an empty array, and an empty file, have no elements; white space
between elements is not part of them; a byte order mark is skipped; what is not one
array (another value, bytes behind the closing bracket, an end inside an element)
is an error that names the file.  Elements are UTF-8 text, parsed by a schema later.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "json_arrays"
SPLIT_BYTES = 32 << 20
READ_ON_BYTES = 1 << 16
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_OPEN, _CLOSE = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"[{", b"]}"))
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\r\n", np.uint8))
_BOM = b"\xef\xbb\xbf"


def filesystem(uri: str):
    """(pyarrow file system, path) of a path or URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


def read_range(uri: str, start: int, end: int) -> bytes:
    files, path = filesystem(uri)
    with files.open_input_file(path) as f:
        return f.read_at(end - start, start)


def bytes_of(r: Range) -> np.ndarray:
    """The bytes of a range, those of a byte order mark as blanks."""
    data = read_range(r.path, r.start, r.end)
    if r.start < len(_BOM) and read_range(r.path, 0, min(len(_BOM), r.size)) == _BOM:
        marked = min(r.end, len(_BOM)) - r.start
        data = b" " * marked + data[marked:]
    return np.frombuffer(data, np.uint8)


def scan(data: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """(which bytes are outside of strings, state at the end) of bytes that begin in ``state``.

    A quote is escaped if the run of backslashes before it is odd; a string's own
    quotes count as outside.
    """
    n = len(data)
    if not n:
        return np.zeros(0, bool), state
    slash = data == 0x5C
    at = np.arange(n)
    last = np.maximum.accumulate(np.where(slash, -1, at))  # the last byte that is no backslash
    run = at - last  # backslashes up to and with this one
    before = np.concatenate([[0], run[:-1]])
    if state == ESCAPED:  # as if a backslash stood before the first byte
        lead = int(np.argmin(slash)) if not slash.all() else n
        before[: lead + 1] += 1
        run[:lead] += 1
    quote = (data == 0x22) & (before % 2 == 0)
    odd = (np.cumsum(quote) + (state != OUTSIDE)) % 2  # inside, from an opening quote on
    end = INSIDE if odd[-1] else OUTSIDE
    if end == INSIDE and slash[-1] and run[-1] % 2:
        end = ESCAPED
    return (odd == 0) | quote, end


def depth_steps(data: np.ndarray, outside: np.ndarray) -> np.ndarray:
    return (_OPEN[data] & outside).astype(np.int64) - (_CLOSE[data] & outside)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int
    state: int = OUTSIDE
    depth: int = 0


def parity_of(r: Range) -> list[tuple]:
    """(path, start, end, size, state at the start, state at the end, change of depth, whether all is blank) for each state."""
    data = bytes_of(r)
    blank, out = bool(_BLANK[data].all()), []
    for state in (OUTSIDE, INSIDE, ESCAPED):
        outside, end = scan(data, state)
        out.append((r.path, r.start, r.end, r.size, state, end, int(depth_steps(data, outside).sum()), blank))
    return out


def elements_of(r: Range) -> Iterator[tuple[int, bytes]]:
    """(place of its first byte, text) of the elements whose border, the bracket or comma before them, lies in the range."""
    bytes_, end, state, depth = bytes_of(r), r.end, r.state, r.depth
    data = bytes_.tobytes()
    outside, state = scan(bytes_, state)
    level = depth + np.cumsum(depth_steps(bytes_, outside))
    opens = outside & _OPEN[bytes_] & (level == 1) & (bytes_ == 0x5B)
    border = np.flatnonzero(opens | outside & (bytes_ == 0x2C) & (level == 1) | outside & _CLOSE[bytes_] & (level == 0))
    stray = np.flatnonzero(outside & ~_BLANK[bytes_] & (level == 0) & ~_CLOSE[bytes_] | outside & (level < 0) | outside & _OPEN[bytes_] & (level == 1) & ~opens)
    closes = np.flatnonzero(outside & _CLOSE[bytes_] & (level == 0))
    if len(stray) or len(closes) > 1 or len(closes) and bytes_[closes[0]] != 0x5D:
        raise ValueError(f"{r.path} is not one JSON array")
    begin = None  # of the element that is open
    for at in border.tolist():
        if begin is not None:
            yield from _element(r, begin, data[begin:at], bytes_[at] == 0x5D and bytes_[begin - 1] == 0x5B)
        begin = at + 1 if bytes_[at] != 0x5D or level[at] > 0 else None
    if begin is None:
        return
    tail, first, depth = [data[begin:]], begin, int(level[-1])
    while end < r.size:  # the last element goes on
        more = read_range(r.path, end, min(end + READ_ON_BYTES, r.size))
        end += len(more)
        part = np.frombuffer(more, np.uint8)
        outside, state = scan(part, state)
        level = depth + np.cumsum(depth_steps(part, outside))
        stop = np.flatnonzero(outside & ((part == 0x2C) & (level == 1) | _CLOSE[part] & (level == 0)))
        if len(stop):
            text = b"".join([*tail, more[: stop[0]]])
            yield from _element(r, first, text, part[stop[0]] == 0x5D and data[begin - 1 : begin] == b"[")
            return
        tail.append(more)
        depth = int(level[-1]) if len(level) else depth
    raise ValueError(f"{r.path} ends inside an array")


def _element(r: Range, begin: int, text: bytes, alone: bool) -> Iterator[tuple[int, bytes]]:
    """The element between two borders; only between the two brackets may there be none."""
    own = text.strip(b" \t\r\n")
    if own:
        yield r.start + begin, own
    elif not alone:
        raise ValueError(f"{r.path} has an empty place in its array")


class Reader(DataSourceReader):
    def __init__(self, options):
        self.mode, self.ranges = options["mode"], [Range(*x) for x in json.loads(options["ranges"])]

    def partitions(self):
        return self.ranges

    def read(self, partition):
        if self.mode == "parity":
            yield from parity_of(partition)
            return
        place, text = [], []
        for p, t in elements_of(partition):
            place.append(p)
            text.append(t)
            if len(text) == 10_000:
                yield _batch(partition.path, place, text)
                place, text = [], []
        yield _batch(partition.path, place, text)


def _batch(path: str, place: list[int], text: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(place), pa.string()), pa.array(place, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], names=["file", "at", "json"])


@dataclass
class Written(WriterCommitMessage):
    waiting: str
    path: str


class Writer(DataSourceArrowWriter):
    """One file for each task, written under another name and renamed when all tasks are done."""

    def __init__(self, options):
        self.folder = options["path"].rstrip("/")

    def write(self, iterator):
        files, folder = filesystem(self.folder)
        files.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.json"
        waiting = f"{folder}/.{name}.part"
        with files.open_output_stream(waiting) as out:
            out.write(b"[")
            some = False
            for batch in iterator:
                rows = batch.column(0).drop_null().to_pylist()
                if rows:
                    out.write((",\n" if some else "").encode() + ",\n".join(rows).encode())
                    some = True
            out.write(b"]")
        return Written(waiting, f"{folder}/{name}")

    def commit(self, messages):
        files, _ = filesystem(self.folder)
        for m in messages:
            if m is not None:
                files.move(m.waiting, m.path)

    def abort(self, messages):
        files, _ = filesystem(self.folder)
        for m in messages:
            if m is not None:
                files.delete_file(m.waiting)


class JsonArrays(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        if self.options.get("mode") == "parity":
            return "file string, start long, stop long, size long, state int, state_after int, depth int, blank boolean"
        return "file string, at long, json string" if "mode" in self.options else "json string"

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options)


def _source(spark: SparkSession, mode: str, ranges: list) -> DataFrame:
    spark.dataSource.register(JsonArrays)
    return spark.read.format(NAME).option("mode", mode).option("ranges", json.dumps(ranges)).load()


def files_of(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, int]]:
    """(path, size) of the files of paths or globs, without reading them."""
    found = spark.read.format("binaryFile").load(paths).select("path", "length").orderBy("path").collect()
    return [(r["path"], r["length"]) for r in found]


def starts(parity: DataFrame) -> list[tuple]:
    """(path, start, end, size, state, depth) of every range: the maps of a file's ranges composed in order."""
    maps: dict[str, dict[int, dict[int, tuple]]] = {}
    for r in parity.collect():  # three rows of a few numbers for each range
        maps.setdefault(r["file"], {}).setdefault(r["start"], {})[r["state"]] = tuple(r)
    out = []
    for file, ranges in sorted(maps.items()):
        state = depth = 0
        begun = False
        for start in sorted(ranges):
            _, _, stop, size, _, after, change, blank = ranges[start][state]
            if begun and not depth and not blank:
                raise ValueError(f"{file} is not one JSON array")
            begun = begun or not blank
            out.append((file, start, stop, size, state, depth))
            state, depth = after, depth + change
        if state != OUTSIDE or depth:
            raise ValueError(f"{file} ends inside an array")
    return out


def elements(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, at, json): the elements of the arrays of files, each with the place where it begins."""
    ranges = [(p, a, min(a + split_bytes, n), n) for p, n in files_of(spark, paths) for a in range(0, n, split_bytes)]
    if not ranges:
        return spark.createDataFrame([], "file string, at long, json string")
    return _source(spark, "elements", starts(_source(spark, "parity", ranges)))


def read_json_arrays(spark: SparkSession, paths: str | list[str], schema: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of ``schema``, with the file that each came from and the byte ``at`` which it begins."""
    rows = elements(spark, paths, split_bytes).select("file", "at", F.from_json("json", schema).alias("r"))
    return rows.select("r.*", "file", "at")


def write_json_arrays(df: DataFrame, folder: str) -> None:
    """Each task's rows as one array in a file of its own; nulls are kept."""
    from pyarrow.fs import FileSelector

    files, path = filesystem(folder)
    if files.get_file_info(FileSelector(path, allow_not_found=True)):
        raise FileExistsError(folder)
    df.sparkSession.dataSource.register(JsonArrays)
    rows = df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("json"))
    rows.write.format(NAME).mode("append").option("path", folder).save()
