"""Reports of tools as a source that Spark plans: ``spark.read.format("tool_report")``, split by files and ranges of bytes, with filters pushed into the scan."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith
from pyspark.sql.types import StructType

from .findings import RULE_KEYS

SCHEMA = "concept string, path string, line long, message string, tool string, rule string, level string, file string"
REFUSED = "file string, reason string"
#: Formats whose files can be cut between lines, and those that are read as one document of at most so many bytes.
BY_LINE, BY_DOCUMENT, MOST_BYTES = ("jsonl", "text"), ("sarif", "checkstyle", "json"), 64 << 20
ROWS = 4096
TEXT = r"^(.+?):(\d+):(?:\d+:)?\s*(.*)$"


@dataclass
class Piece(InputPartition):
    """The bytes [start, stop) of a file of lines, where a line belongs to the piece in which it begins; or documents, each with its size."""

    file: str = ""
    start: int = 0
    stop: int = 0
    documents: tuple[tuple[str, int], ...] = ()


def _files(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """The files at a path: itself, or all regular files below it whose names don't begin with a dot or an underscore, in the order of their names."""
    system, place = pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (pafs.LocalFileSystem(), path)
    info = system.get_file_info(place)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [x for x in system.get_file_info(pafs.FileSelector(place, recursive=True)) if x.is_file]
    hidden = lambda x: info.type == pafs.FileType.Directory and any(p[:1] in "._" for p in x.path[len(info.path) :].strip("/").split("/"))
    return system, sorted((x for x in found if not hidden(x)), key=lambda x: x.path)


def _number(value) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def _at(value, dotted: str):
    for key in dotted.split(".") if dotted else []:
        value = value.get(key) if isinstance(value, dict) else None
    return value


class Reader(DataSourceReader):
    """Reads findings; what is asked of ``tool``, ``concept``, ``file``, ``path``, ``rule`` and ``level`` (equal, one of, not null, beginning of a path) is left out before rows are made."""

    PUSHED = ("tool", "concept", "file", "path", "rule", "level")

    def __init__(self, options: dict, schema: StructType, refusals: bool) -> None:
        self.options, self.refusals = {k.lower(): v for k, v in options.items()}, refusals
        self.names = schema.fieldNames()
        self.kind = self.options.get("kind", "text")
        if self.kind not in BY_LINE + BY_DOCUMENT:
            raise ValueError(f"unknown kind of report {self.kind!r}: {', '.join(BY_LINE + BY_DOCUMENT)}")
        if "path" not in self.options:
            raise ValueError("load() needs the path of a report, or of a folder of reports")
        self.tool, self.concept = self.options.get("tool", self.kind), self.options.get("concept")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if self.refusals or column not in self.PUSHED:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "given", None))
            else:
                yield f

    def _passes(self, **known) -> bool:
        def holds(value, how, want):
            if how == "in":
                return value in want
            return value is not None and (how == "given" or value.startswith(want))

        return all(holds(known[c], how, want) for c, how, want in self.tests if c in known)

    def partitions(self) -> list[InputPartition]:
        """A piece for each ``splitBytes`` of lines of a file, or of whole documents; none for files that the filters leave out."""
        if self.kind != "sarif" and not self._passes(tool=self.tool, concept=self.concept):
            return [Piece()]
        step, out, held, size = int(self.options.get("splitbytes", 64 << 20)), [], [], 0
        for info in _files(self.options["path"])[1]:
            if not self._passes(file=info.path) or not info.size:
                continue
            if self.kind in BY_LINE:
                out += [Piece(info.path, at, min(info.size, at + step)) for at in range(0, info.size, step)]
                continue
            if held and size + info.size > step:
                out, held, size = [*out, Piece(documents=tuple(held))], [], 0
            held.append((info.path, info.size))
            size += info.size
        if held:
            out.append(Piece(documents=tuple(held)))
        return out or [Piece()]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.file and not piece.documents:
            return
        system = pafs.FileSystem.from_uri(self.options["path"])[0] if re.match(r"[a-z][a-z0-9+.-]*:", self.options["path"]) else pafs.LocalFileSystem()
        if self.kind in BY_LINE:
            rows = iter(()) if self.refusals else self._of_lines(system, piece)
        else:
            rows = (row for name, size in piece.documents for row in self._of_document(system, Piece(name, 0, size)))
        kinds = pa.schema([(n, pa.int64() if n == "line" else pa.string()) for n in self.names])
        batch: list[dict] = []
        for row in rows:
            if self.refusals or self._passes(**{k: row.get(k) for k in self.PUSHED}):
                batch.append(row)
            if len(batch) >= ROWS:
                yield pa.RecordBatch.from_pylist(batch, kinds)
                batch = []
        if batch:
            yield pa.RecordBatch.from_pylist(batch, kinds)

    def _finding(self, piece: Piece, path, line, message, rule=None, level=None, tool=None) -> dict:
        return {"concept": self.concept, "path": path or "", "line": _number(line) or None, "message": message or "", "tool": tool or self.tool, "rule": rule, "level": level, "file": piece.file}

    def _of_lines(self, system: pafs.FileSystem, piece: Piece) -> Iterator[dict]:
        pattern, keys = re.compile(self.options.get("pattern", TEXT)), self.options.get("keys", "path,line,message").split(",")
        with system.open_input_file(piece.file) as f:
            f.seek(max(0, piece.start - 1))
            lines = _lines(f)
            at = piece.start
            if piece.start:
                at += len(next(lines, b"")) - 1  # the line that began before belongs to the piece before
            for raw in lines:
                if at >= piece.stop:
                    return
                at += len(raw)
                text = raw.decode("utf-8", "replace").rstrip("\r\n")
                if self.kind == "text":
                    if m := pattern.match(text):
                        yield self._finding(piece, m[1], m[2], m[3])
                elif text.lstrip().startswith("{"):
                    try:
                        item = json.loads(text)
                    except ValueError:
                        continue
                    yield self._item(piece, item, keys)

    def _item(self, piece: Piece, item: dict, keys: list[str]) -> dict:
        rule = next((str(item[k]) for k in RULE_KEYS if item.get(k)), None)
        path, line, message = (_at(item, k) for k in keys)
        return self._finding(piece, path and str(path), line, message and str(message), rule)

    def _of_document(self, system: pafs.FileSystem, piece: Piece) -> Iterator[dict]:
        refused, raw = None, b""
        if piece.stop > MOST_BYTES:
            refused = "larger than 64 MiB"
        else:
            with system.open_input_file(piece.file) as f:
                raw = f.read()
            if self.kind == "checkstyle" and re.search(rb"(?i)<!(DOCTYPE|ENTITY)", raw):
                refused = "declares a document type or entities"
        found: list[dict] = []
        if refused is None:
            try:
                found = list({"sarif": self._sarif, "checkstyle": self._checkstyle, "json": self._json}[self.kind](piece, raw))
            except (ValueError, ET.ParseError, AttributeError, TypeError, KeyError):
                refused = "not read as " + self.kind
        if self.refusals:
            yield from [{"file": piece.file, "reason": refused}] if refused else []
        else:
            yield from found

    def _sarif(self, piece: Piece, raw: bytes) -> Iterator[dict]:
        for run in json.loads(raw).get("runs") or []:
            tool = _at(run, "tool.driver.name")
            for r in run.get("results") or []:
                place = _at((r.get("locations") or [{}])[0], "physicalLocation") or {}
                yield self._finding(piece, _at(place, "artifactLocation.uri"), _at(place, "region.startLine") or 1, _at(r, "message.text"), r.get("ruleId") or "unknown", r.get("level") or "warning", tool)

    def _checkstyle(self, piece: Piece, raw: bytes) -> Iterator[dict]:
        for file in ET.fromstring(raw).iter("file"):
            for e in file.iter("error"):
                yield self._finding(piece, file.get("name"), e.get("line"), e.get("message"), e.get("source") or e.get("rule"), e.get("severity"))

    def _json(self, piece: Piece, raw: bytes) -> Iterator[dict]:
        keys = self.options.get("keys", "path,line,message").split(",")
        for item in _at(json.loads(raw), self.options.get("items", "")) or []:
            yield self._item(piece, item, keys)


def _lines(f) -> Iterator[bytes]:
    """The lines of an open file with their ends, in blocks of a MB."""
    rest = b""
    while block := f.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        for x in whole:
            yield x + b"\n"
    if rest:
        yield rest


class ToolReports(DataSource):
    """Findings in tools' reports: (concept, path, line, message, tool, rule, level, file); with the option ``refusals`` the reports that are not read, and why.

    Options: ``kind`` (sarif, checkstyle, json, jsonl, text), ``tool``, ``concept``, ``keys`` (of path, line and message in an item), ``items``
    (dotted path of the array of items in a json document), ``pattern`` (text: groups path, line, message), ``splitBytes``.
    Lines that are no finding are skipped; of SARIF a missing rule is ``unknown``, level ``warning``, line 1; elsewhere a line 0 or none is null; a missing path or message is empty. Documents beyond 64 MiB, XML that declares
    entities and documents that do not parse give no rows. Paths are URIs of file systems that Arrow knows, or local ones.
    """

    @classmethod
    def name(cls) -> str:
        return "tool_report"

    def _refusals(self) -> bool:
        return {k.lower(): v for k, v in self.options.items()}.get("refusals", "false").lower() == "true"

    def schema(self) -> str:
        return REFUSED if self._refusals() else SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(dict(self.options), schema, self._refusals())


def register(spark: SparkSession) -> None:
    """Makes ``tool_report`` a format of the session, and lets Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ToolReports)


def tool_reports(spark: SparkSession, path: str, kind: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("tool_report").options(kind=kind, **{k: str(v) for k, v in options.items()}).load(path)
