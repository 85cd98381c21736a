"""A JSON object or array that fills a file: read by many tasks, in byte ranges, and written by many tasks as one file.

A range begins anywhere, maybe within a string or deep within a value. Whether it does follows from what stands before it: each
range says how many quotes it has, and how many levels it goes up or down if it begins outside or inside of a string; these few
numbers, added up in order, give the state at the start of every range (`read_entries`). A task then finds the entries whose
separator (the bracket or comma before them) lies in its range, and reads on until the last of them ends. Texts are scanned in
blocks of bytes with numpy; what a task holds is a block and one entry.

Level 1 are the entries of the file's object or array; level 2 those of its members, of which one can be picked.

Files are opened with pyarrow's file systems (local folders, and those it has a client for). A key that is repeated gives a row for
each place. Text that ends within a string or a bracket raises a ValueError; entries are not parsed here.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "json_entries"
#: Bytes of a range at most and, if there are fewer ranges than cores, at least; and of a block that is scanned at once.
RANGE, LEAST_RANGE, BLOCK = 64 << 20, 64 << 10, 4 << 20
#: Entries that are put together before they are written.
LINES = 256
ENTRIES = "file string, ord long, member string, key string, value string"
STATES = "file string, start long, parity int, outside int, inside int"
CENSUS = "file string, start long, entries long, separator long, colon long"

QUOTE, SLASH, COMMA, COLON = b'"\\,:'
_OPEN, _CLOSE = list(b"{["), list(b"}]")
_MARKS = np.zeros(256, bool)
_MARKS[[QUOTE, SLASH, COMMA, COLON, *_OPEN, *_CLOSE]] = True
_STEP = np.zeros(256, np.int64)
_STEP[_OPEN], _STEP[_CLOSE] = 1, -1


# ---- files ---------------------------------------------------------------------------------------------


def located(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in path:
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path.removeprefix("file:")


def list_files(path: str) -> list[tuple[str, int]]:
    """Files and sizes of a path: itself, or those in a folder, but for hidden ones. None if it is missing."""
    fs, at = located(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = fs.get_file_info(at)
    if info.type == pa.fs.FileType.File:
        return [(path, info.size)]
    if info.type == pa.fs.FileType.NotFound:
        return []
    found = fs.get_file_info(pa.fs.FileSelector(at))
    return sorted((prefix + f.path, f.size) for f in found if f.type == pa.fs.FileType.File and not f.base_name.startswith((".", "_")))


class Source:
    """A file, read from any place on."""

    def __init__(self, file: str):
        fs, at = located(file)
        self.handle = fs.open_input_file(at)

    def bytes(self, start: int, end: int) -> bytes:
        return self.handle.read_at(end - start, start)

    def blocks(self, start: int, end: int | None = None) -> Iterator[bytes]:
        end = self.handle.size() if end is None else end
        for at in range(start, end, BLOCK):
            yield self.bytes(at, min(end, at + BLOCK))

    def escaped(self, at: int) -> bool:
        """Whether an odd number of backslashes stands right before a place."""
        n = 0
        while at and self.bytes(at - 1, at) == b"\\":
            n, at = n + 1, at - 1
        return n % 2 == 1


# ---- scanning ------------------------------------------------------------------------------------------


def _marks(block: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Places of quotes that begin or end strings, places and bytes of all brackets, commas and colons, and whether the byte after the block is escaped."""
    b = np.frombuffer(block, np.uint8)
    places = np.flatnonzero(_MARKS[b])
    kinds = b[places]
    quotes, slashes = places[kinds == QUOTE], places[kinds == SLASH]
    # A run of backslashes escapes what follows it if their number is odd; the first of them may itself be escaped.
    hidden = [0] if escaped and len(b) and b[0] != SLASH else []
    after = escaped and not len(b)
    if len(slashes):
        first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        length = np.diff(first, append=len(slashes))
        length[0] -= escaped and slashes[0] == 0
        odd = slashes[np.append(first[1:], len(slashes)) - 1][length % 2 == 1] + 1
        after = bool(len(odd)) and int(odd[-1]) == len(b)
        hidden = np.concatenate([hidden, odd])
    if len(hidden):
        quotes = np.setdiff1d(quotes, hidden, assume_unique=True)
    other = (kinds != QUOTE) & (kinds != SLASH)
    return quotes, places[other], kinds[other], after


class Scanner:
    """Brackets, commas and colons outside of strings, block by block, with the depth they stand at."""

    def __init__(self, at: int, inside: bool, depth: int, escaped: bool):
        self.at, self.inside, self.depth, self.escaped = at, inside, depth, escaped

    def feed(self, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the file, bytes, and the depth before each (an opening bracket stands at its outer depth, a closing one at its inner)."""
        quotes, places, kinds, self.escaped = _marks(block, self.escaped)
        outside = (np.searchsorted(quotes, places) + self.inside) % 2 == 0
        places, kinds = places[outside], kinds[outside]
        step = _STEP[kinds]
        depth = self.depth + np.cumsum(step)
        out = places + self.at, kinds, depth - step
        self.inside ^= bool(len(quotes) % 2)
        self.depth, self.at = int(depth[-1]) if len(depth) else self.depth, self.at + len(block)
        return out


def state_of(source: Source, start: int, end: int) -> tuple[int, int, int]:
    """Parity of a range's quotes, and the levels it goes up if it begins outside or inside of a string."""
    parity, levels, escaped = 0, [0, 0], source.escaped(start)
    for block in source.blocks(start, end):
        quotes, places, kinds, escaped = _marks(block, escaped)
        odd = (np.searchsorted(quotes, places) + parity) % 2
        for k in (0, 1):
            levels[k] += int(_STEP[kinds[odd == k]].sum())
        parity = (parity + len(quotes)) % 2
    return parity, levels[0], levels[1]


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    inside: bool = False
    depth: int = 0
    separator: int = -1  # the last bracket or comma of level 1 before the range
    colon: int = -1  # the last colon of level 1 before it
    first: int = 0  # entries before it


def census_of(source: Source, r: Range, level: int) -> tuple[int, int, int]:
    """Separators of a range's entries, and its last separator and colon of level 1."""
    scanner, n, separator, colon = Scanner(r.start, r.inside, r.depth, source.escaped(r.start)), 0, -1, -1
    for block in source.blocks(r.start, r.end):
        places, kinds, depth = scanner.feed(block)
        opens = np.isin(kinds, _OPEN)
        separates = opens | (kinds == COMMA)
        at = depth + opens
        n += int((separates & (at == level)).sum())
        for found, mask in (("s", separates & (at == 1)), ("c", (kinds == COLON) & (depth == 1))):
            if mask.any():
                separator, colon = (int(places[mask][-1]), colon) if found == "s" else (separator, int(places[mask][-1]))
    return n, separator, colon


def entries_of(source: Source, r: Range, level: int) -> Iterator[tuple[int, str | None, str | None, bytes]]:
    """ord, member, key, value of the entries whose separator lies in a range. An empty container counts as an entry without a row."""
    name = lambda text: json.loads(text.strip() or "null")
    scanner, n = Scanner(r.start, r.inside, r.depth, source.escaped(r.start)), r.first
    separator = r.separator
    member = name(source.bytes(separator + 1, r.colon)) if level == 2 and r.colon > separator else None
    text, base = bytearray(), r.start  # from `base` on
    begun = colon = None
    for block in source.blocks(r.start):
        text += block
        places, kinds, depth = scanner.feed(block)
        opens = np.isin(kinds, _OPEN)
        for p, c, d in zip(*(x[depth + opens <= level].tolist() for x in (places, kinds, depth))):
            if c == COLON:
                if d == level:
                    colon = p if colon is None else colon
                elif d == 1:
                    member = name(source.bytes(separator + 1, p))
                continue
            if d == level and begun is not None and c not in _OPEN:  # a comma or closing bracket ends an entry
                if value := bytes(text[(begun if colon is None else colon + 1) - base : p - base]).strip():
                    yield n, member, None if colon is None else name(bytes(text[begun - base : colon - base])), value
                n, begun = n + 1, None
            if p >= r.end:
                return
            if c == COMMA or c in _OPEN:
                if d + (c in _OPEN) == level:
                    begun, colon = p + 1, None
                if d + (c in _OPEN) == 1:
                    separator = p
        if begun is None and scanner.at >= r.end:
            break
        cut = (scanner.at if begun is None else begun) - base
        del text[:cut]
        base += cut
    if begun is not None or (scanner.at == source.handle.size() and (scanner.inside or scanner.depth)):
        raise ValueError(f"{r.file} ends within a string or bracket")


# ---- the data source -----------------------------------------------------------------------------------


class JsonEntries(DataSource):
    """Options: path; mode (entries, states, census), level (1, 2), member; plan (the ranges); to write: kind (object, array), members."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return {"entries": ENTRIES, "states": STATES, "census": CENSUS}[self.options.get("mode", "entries")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.mode, self.level, self.member = options.get("mode", "entries"), int(options.get("level", 1)), options.get("member")
        self.ranges = [Range(*r) for r in json.loads(options["plan"])]
        self.names = schema.fieldNames()

    def partitions(self) -> list[Range]:
        return self.ranges

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        source = Source(r.file)
        if self.mode == "states":
            yield self._batch([(r.file, r.start, *state_of(source, r.start, r.end))], [pa.string(), pa.int64(), *[pa.int32()] * 3])
        elif self.mode == "census":
            yield self._batch([(r.file, r.start, *census_of(source, r, self.level))], [pa.string(), *[pa.int64()] * 4])
        else:
            rows, size = [], 0
            for n, member, key, value in entries_of(source, r, self.level):
                if self.member is None or member == self.member:
                    rows.append((r.file, n, member, key, value.decode()))
                    size += len(value)
                if len(rows) >= 10_000 or size >= BLOCK:
                    yield self._batch(rows, [pa.string(), pa.int64(), *[pa.string()] * 3])
                    rows, size = [], 0
            yield self._batch(rows, [pa.string(), pa.int64(), *[pa.string()] * 3])

    def _batch(self, rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], self.names)


def _read(spark: SparkSession, ranges: list[Range], **options) -> DataFrame:
    spark.dataSource.register(JsonEntries)
    plan = json.dumps([[r.file, r.start, r.end, r.inside, r.depth, r.separator, r.colon, r.first] for r in ranges])
    return spark.read.format(FORMAT).options(plan=plan, **options).load()


def read_entries(spark: SparkSession, path: str, level: int = 1, member: str | None = None, range_bytes: int | None = None) -> DataFrame:
    """file, ord, member, key (null in arrays), value (JSON text) of the entries of every file in path.

    ord counts the places of a file from 0 on. For files of more than one range, two scans of their bytes come first, of which
    the driver gets a row for each range.
    """
    files = list_files(path)
    if not files:
        raise FileNotFoundError(path)
    even = sum(size for _, size in files) // spark.sparkContext.defaultParallelism
    range_bytes = range_bytes or min(RANGE, max(LEAST_RANGE, even))
    ranges = [Range(f, i, min(i + range_bytes, size)) for f, size in files for i in range(0, size, range_bytes)]
    if not ranges:
        return spark.createDataFrame([], ENTRIES)
    if any(r.start for r in ranges):
        states = {(x.file, x.start): x for x in _read(spark, ranges, mode="states").collect()}
        for before, r in zip(ranges, ranges[1:]):
            if r.start:
                x = states[before.file, before.start]
                r.inside, r.depth = before.inside ^ bool(x.parity), before.depth + (x.inside if before.inside else x.outside)
        counts = {(x.file, x.start): x for x in _read(spark, ranges, mode="census", level=level).collect()}
        for before, r in zip(ranges, ranges[1:]):
            if r.start:
                x = counts[before.file, before.start]
                r.first = before.first + x.entries
                r.separator, r.colon = max(before.separator, x.separator), max(before.colon, x.colon)
    options = {"member": member} if member is not None else {}
    return _read(spark, ranges, level=level, **options)


# ---- writing -------------------------------------------------------------------------------------------


@dataclass
class _Fragments(WriterCommitMessage):
    partition: int
    parts: list[tuple[str | None, bool, str]]  # member, whether its entries have keys, file


def _quoted(key: str) -> str:
    return json.encoder.encode_basestring(key)


def _alike(members: list) -> Iterator[tuple[int, int]]:
    """First and end of each run of equal members."""
    first = 0
    for i in range(1, len(members) + 1):
        if i == len(members) or members[i] != members[first]:
            yield first, i
            first = i


class _Writer(DataSourceArrowWriter):
    """Tasks write the entries of each member to files of their own; committing puts these together, in the order of partitions."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], options.get("kind", "object"), overwrite
        self.members = json.loads(options.get("members", "[]"))  # (member, kind), in their order; there even if they have no entry
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = located(self.folder)
        fs.create_dir(folder, recursive=True)
        parts, out, last = [], None, None
        for batch in batches:
            members, keys = batch.column("member").to_pylist(), batch.column("key").to_pylist()
            values = batch.column("value")
            for i, j in _alike(members):
                begun = out is not None and members[i] == last
                if not begun:
                    if out:
                        out.close()
                    file, last = f"{self.folder}/{uuid.uuid4().hex}", members[i]
                    out = fs.open_output_stream(located(file)[1])
                    parts.append((last, keys[i] is not None, file))
                for a in range(i, j, LINES):
                    b = min(j, a + LINES)
                    lines = [v if k is None else f"{_quoted(k)}: {v}" for k, v in zip(keys[a:b], values.slice(a, b - a).to_pylist())]
                    out.write((",\n" * (begun or a > i) + ",\n".join(lines)).encode())
        if out:
            out.close()
        return _Fragments(TaskContext.get().partitionId(), parts)

    def commit(self, messages: list[_Fragments]) -> None:
        fs, target = located(self.path)
        if not self.overwrite and fs.get_file_info(target).type != pa.fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.path)
        found: dict = {m: (kind == "object", []) for m, kind in self.members}
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for member, keyed, file in m.parts:
                found.setdefault(member, (keyed, []))[1].append(file)
        with fs.open_output_stream(whole := f"{target}.{uuid.uuid4().hex}") as out:
            top = found.pop(None, (False, []))[1]
            groups = [(None, None, top)] * bool(top) + [(m, keyed, files) for m, (keyed, files) in found.items()]
            out.write(b"{\n" if self.kind == "object" else b"[\n")
            for i, (member, keyed, files) in enumerate(groups):
                out.write(b",\n" * bool(i))
                if member is not None:
                    out.write(f"{json.dumps(member, ensure_ascii=False)}: {'{' if keyed else '['}\n".encode())
                for j, file in enumerate(files):
                    out.write(b",\n" * bool(j))
                    for block in Source(file).blocks(0):  # a block at a time
                        out.write(block)
                if member is not None:
                    out.write(b"\n}" if keyed else b"\n]")
            out.write(b"\n}\n" if self.kind == "object" else b"\n]\n")
        if fs.get_file_info(target).type == pa.fs.FileType.Directory:
            fs.delete_dir(target)
        fs.move(whole, target)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, folder = located(self.folder)
        if fs.get_file_info(folder).type != pa.fs.FileType.NotFound:
            fs.delete_dir(folder)


def write_entries(df: DataFrame, path: str, kind: str = "object", members: list[tuple[str, str]] | None = None, mode: str = "append") -> None:
    """member, key, value (JSON text) as one file, in the order of df's partitions and rows; without member they are the file's own entries.

    Entries of a member, or of the file, all have a key (an object) or all have none (an array). mode "append" doesn't replace a file.
    """
    df.sparkSession.dataSource.register(JsonEntries)
    df.select("member", "key", "value").write.format(FORMAT).mode(mode).options(path=path, kind=kind, members=json.dumps(members or [])).save()
