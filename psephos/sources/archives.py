"""Zip archives and workbooks as Python data sources: planned from the central directory, a partition per member.

The planner reads an archive's directory, some bytes at its end, and plans a task for each member that is asked for. A
task seeks to its member, reads its byte range in pieces and inflates them as they come, so an archive of many members is
read by many tasks and a member of any size needs a few megabytes. The member's CRC is checked at its end.

Files are opened with ``pyarrow.fs``: local paths, and URIs of the stores that it knows. ``register`` makes the formats
``ziplines``, ``zipmembers``, ``xlsxcells`` and the sink ``archives`` known to a session.
"""

from __future__ import annotations

import codecs
import io
import posixpath
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes that are read at once, and rows of a batch.
PIECE, ROWS = 1 << 20, 4096


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match("file:/*", path):
        path = "/" + re.sub("^file:/*", "", path)
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def files_below(path: str, ending: str) -> list[str]:
    """The file itself, or the files of a folder with this ending, as paths of its own kind."""
    system, inner = store(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and i.base_name.endswith(ending))
    return [posixpath.join(path, n) for n in names]


@dataclass
class Member(InputPartition):
    """A member of an archive: where its local header stands, and how it is packed."""

    path: str
    name: str
    offset: int
    packed: int
    size: int
    method: int
    crc: int
    #: For sheets: their title, and the member with the workbook's shared strings.
    title: str = ""
    shared: Member | None = None

    def __post_init__(self) -> None:
        super().__init__(self.name)


def members(path: str) -> list[Member]:
    """The members of an archive from its central directory; the rest of it is not read."""
    system, inner = store(path)
    with system.open_input_file(inner) as file, zipfile.ZipFile(file) as archive:
        infos = [i for i in archive.infolist() if not i.is_dir()]
    for i in infos:
        if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or i.flag_bits & 1:
            raise ValueError(f"{path}: {i.filename} is encrypted or packed by method {i.compress_type}")
    return [Member(path, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC) for i in infos]


def pieces(member: Member) -> Iterator[bytes]:
    """The member's bytes, inflated as they are read."""
    system, inner = store(member.path)
    with system.open_input_file(inner) as file:
        file.seek(member.offset)
        # The local header: 30 bytes, the last four of which are the lengths of name and extra field.
        name, extra = struct.unpack("<26x2H", file.read(30))
        file.seek(member.offset + 30 + name + extra)
        left, crc, size = member.packed, 0, 0
        inflate = zlib.decompressobj(-15) if member.method == zipfile.ZIP_DEFLATED else None
        while left:
            raw = file.read(min(PIECE, left))
            if not raw:
                raise ValueError(f"{member.path}: {member.name} is cut off")
            left -= len(raw)
            while raw:
                out = inflate.decompress(raw, PIECE) if inflate else raw
                raw = inflate.unconsumed_tail if inflate else b""
                crc, size = zlib.crc32(out, crc), size + len(out)
                if out:
                    yield out
        rest = inflate.flush() if inflate else b""
        crc, size = zlib.crc32(rest, crc), size + len(rest)
        if rest:
            yield rest
        if crc != member.crc or size != member.size:
            raise ValueError(f"{member.path}: {member.name} is damaged")


def lines(member: Member, encoding: str = "utf-8") -> Iterator[str]:
    """The member's lines, ended by line feeds with or without carriage returns; behind the last end only if something stands there."""
    decode, rest = codecs.getincrementaldecoder(encoding)(), ""
    for piece in pieces(member):
        *whole, rest = (rest + decode.decode(piece)).split("\n")
        for line in whole:
            yield line.removesuffix("\r")
    rest += decode.decode(b"", final=True)
    if rest:
        yield rest.removesuffix("\r")


class Inflated(io.RawIOBase):
    """A member as a readable file."""

    def __init__(self, member: Member):
        self.source, self.held = pieces(member), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        if not self.held:
            self.held = next(self.source, b"")
        n = min(len(buffer), len(self.held))
        buffer[:n], self.held = self.held[:n], self.held[n:]
        return n


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


class _Source(DataSource):
    """Options: path, pattern (of whole member names or sheet titles)."""

    ending = ".zip"

    def _wanted(self) -> Iterator[tuple[str, list[Member]]]:
        for path in files_below(self.options["path"], self.ending):
            yield path, members(path)

    def _matches(self, name: str) -> bool:
        return bool(re.fullmatch(self.options.get("pattern", ".*"), name, re.S))

    def plan(self) -> list[Member]:
        return [m for _, found in self._wanted() for m in found if self._matches(m.name)]


class _Reader(DataSourceReader):
    def __init__(self, source: _Source):
        self.source = source

    def partitions(self) -> list[Member]:
        # One task of nothing where nothing is asked for.
        return self.source.plan() or [InputPartition(None)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if getattr(partition, "path", None):  # none where there is nothing to read
            yield from self.source.rows(partition)


class ZipLines(_Source):
    """(path, member, pos, line) of text members; option encoding."""

    @classmethod
    def name(cls) -> str:
        return "ziplines"

    def schema(self) -> str:
        return "path string, member string, pos bigint, line string"

    def reader(self, schema) -> _Reader:
        return _Reader(self)

    def rows(self, member: Member) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("pos", pa.int64()), ("line", pa.string())])
        yield from _batches(((member.path, member.name, k, line) for k, line in enumerate(lines(member, self.options.get("encoding", "utf-8")))), schema)


class ZipMembers(_Source):
    """(path, member, piece, content): the bytes of members in numbered pieces of about a megabyte; an empty member has one."""

    @classmethod
    def name(cls) -> str:
        return "zipmembers"

    def schema(self) -> str:
        return "path string, member string, piece bigint, content binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self)

    def rows(self, member: Member) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("piece", pa.int64()), ("content", pa.binary())])
        for k, content in enumerate(pieces(member) if member.size else [b""]):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((member.path, member.name, k, content), schema.types, strict=True)], schema=schema)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _elements(member: Member, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag as they close; what was passed is let go."""
    root = None
    for event, element in ElementTree.iterparse(io.BufferedReader(Inflated(member), PIECE), events=("start", "end")):
        if root is None:
            root = element
        if event == "end" and element.tag == tag:
            yield element
            element.clear()
            root.clear()


def _text(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{_NS}t"))


def sheets(path: str) -> list[Member]:
    """The sheets of a workbook by their titles."""
    found = {m.name: m for m in members(path)}
    read = lambda name: ElementTree.fromstring(b"".join(pieces(found[name])))
    targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
    out = []
    for sheet in read("xl/workbook.xml").iter(f"{_NS}sheet"):
        target = targets[sheet.get(_REL)].lstrip("/")
        member = found[target if target in found else f"xl/{target}"]
        out.append(Member(member.path, member.name, member.offset, member.packed, member.size, member.method, member.crc, sheet.get("name"), found.get("xl/sharedStrings.xml")))
    return out


def cells(sheet: Member) -> Iterator[tuple[int, int, str]]:
    """(row, column, text), counted from 1, of the cells with a value. The workbook's different strings are held, the sheet is not."""
    shared = [_text(si) for si in _elements(sheet.shared, f"{_NS}si")] if sheet.shared else []
    for line in _elements(sheet, f"{_NS}row"):
        for cell in line.iter(f"{_NS}c"):
            letters, row = re.fullmatch("([A-Z]+)([0-9]+)", cell.get("r")).groups()
            column = 0
            for letter in letters:
                column = column * 26 + ord(letter) - 64
            value = cell.find(f"{_NS}v")
            text = _text(cell) if cell.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
            if cell.get("t") == "s" and text:
                text = shared[int(text)]
            if text:
                yield int(row), column, text


class XlsxCells(_Source):
    """(path, sheet, row, column, text) of the sheets whose titles match."""

    ending = ".xlsx"

    @classmethod
    def name(cls) -> str:
        return "xlsxcells"

    def schema(self) -> str:
        return "path string, sheet string, row int, column int, text string"

    def reader(self, schema) -> _Reader:
        return _Reader(self)

    def plan(self) -> list[Member]:
        return [s for path in files_below(self.options["path"], self.ending) for s in sheets(path) if self._matches(s.title)]

    def rows(self, member: Member) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("column", pa.int32()), ("text", pa.string())])
        yield from _batches(((member.path, member.title, *c) for c in cells(member)), schema)


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> _Written:
        """The rows of an archive must lie together; an archive is written under a name of its own until all tasks are done."""
        system, folder = store(self.path)
        system.create_dir(folder)
        names, name, file, archive = [], None, None, None

        def close() -> None:
            if archive is not None:
                archive.close()
                file.close()

        for row in iterator:
            if row.archive != name:
                close()
                name = row.archive
                names.append((f".{name}.{uuid.uuid4().hex}", name))
                file = system.open_output_stream(f"{folder}/{names[-1][0]}")
                archive = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)
            archive.writestr(row.member, row.content)
        close()
        return _Written(names)

    def commit(self, messages) -> None:
        system, folder = store(self.path)
        for made, name in (n for m in messages if m is not None for n in m.names):
            system.move(f"{folder}/{made}", f"{folder}/{name}")

    def abort(self, messages) -> None:
        system, folder = store(self.path)
        for made, _ in (n for m in messages if m is not None for n in m.names):
            system.delete_file(f"{folder}/{made}")


class Archives(DataSource):
    """A sink of rows (archive, member, content): zip files in a folder."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return "archive string, member string, content string"

    def writer(self, schema, overwrite) -> _Writer:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (ZipLines, ZipMembers, XlsxCells, Archives):
        spark.dataSource.register(source)


def write_archives(rows: DataFrame, path: str) -> None:
    """Writes (archive, member, content) as zip files; all members of an archive are written by one task, one by one."""
    register(rows.sparkSession)
    rows.select("archive", "member", "content").repartition("archive").sortWithinPartitions("archive", "member").write.format("archives").mode("append").save(path)


def read(spark: SparkSession, kind: str, path: str, **options: str) -> DataFrame:
    """``kind``: ziplines, zipmembers or xlsxcells, of a file or of the files in a folder."""
    register(spark)
    return spark.read.format(kind).options(**options).load(path)
