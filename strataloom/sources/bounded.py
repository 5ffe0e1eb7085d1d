"""Writes that stay inside a root, replace only what is their own, and are whole or not at all.

Everything goes through the file system of the target, so a cluster's shared storage is handled like a local disk: a
new file or folder is made under a name of its own beside the target and renamed over it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of the file by which a folder is known as written here; it says of which kind.
MARK = "_written_as"


class PathNotAllowed(ValueError):
    """A target outside the root, behind a link, or one that holds something else."""


class _Files:
    """The Hadoop file system of a path, by what is needed here."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.system = self.path(path).getFileSystem(self.conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def qualified(self, name: str):
        return self.path(name).makeQualified(self.system.getUri(), self.system.getWorkingDirectory())

    def status(self, path):
        """The status of a path itself, not of what a link at it leads to; null if nothing is there."""
        try:
            return self.context.getFileLinkStatus(path)
        except Exception as e:
            if "FileNotFoundException" in str(e):
                return None
            raise

    def is_link(self, path) -> bool:
        """Whether a path itself is a link; on a local disk the disk is asked, as Hadoop follows links there."""
        if self.system.getScheme() == "file":
            return self.jvm.java.nio.file.Files.isSymbolicLink(self.jvm.java.io.File(path.toUri().getPath()).toPath())
        found = self.status(path)
        return found is not None and found.isSymlink()

    def replace(self, source, target) -> None:
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self.context.rename(source, target, options)

    def text(self, path) -> str:
        stream = self.system.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
        finally:
            stream.close()

    def write(self, path, chunks: Iterable[bytes]) -> None:
        out = self.system.create(path, False)
        try:
            for chunk in chunks:
                out.write(bytearray(chunk))
            out.hsync()
        finally:
            out.close()


def _target(files: _Files, root: str, target: str):
    """The qualified target below the root: neither outside of it by name, nor reached through a link."""
    top = files.qualified(root)
    place = files.qualified(target if "://" in target or target.startswith(("/", "file:")) else f"{root.rstrip('/')}/{target}")
    if ".." in place.toUri().getPath().split("/"):
        raise PathNotAllowed(f"{target} leads outside of {root}")
    above, at = [], place
    while at is not None and not at.equals(top):
        above.append(at)
        at = at.getParent()
    if at is None or not above:
        raise PathNotAllowed(f"{target} is not below {root}")
    for step in reversed(above):
        found = files.status(step)
        if files.is_link(step):
            raise PathNotAllowed(f"{step} is a link")
        if found is not None and not step.equals(place) and not found.isDirectory():
            raise PathNotAllowed(f"{step} is no folder")
    return place


def write_text(spark: SparkSession, root: str, target: str, body: str | Iterable[bytes], json_only: bool = False) -> str:
    """Replaces a file below ``root`` as a whole; returns its path. A reader sees the old file or the new one.

    With ``json_only`` a file that does not parse as JSON, which nobody here wrote, is refused. A link, a folder and paths that leave the root are, too. ``body``:
    a text, or blocks of bytes, which pass through the driver one at a time.
    """
    files = _Files(spark, root)
    place = _target(files, root, target)
    found = files.status(place)
    if found is not None and not found.isFile():
        raise PathNotAllowed(f"{place} is no regular file")
    if json_only and found is not None:
        try:
            json.loads(files.text(place))
        except ValueError:
            raise PathNotAllowed(f"{place} is there and holds no JSON") from None
    files.system.mkdirs(place.getParent())
    waiting = files.path(f"{place.getParent()}/.{place.getName()}.{uuid.uuid4().hex}")
    try:
        files.write(waiting, [body.encode()] if isinstance(body, str) else body)
        files.replace(waiting, place)
    except BaseException:
        files.system.delete(waiting, True)
        raise
    return str(place)


def _own(files: _Files, place, kind: str) -> bool:
    mark = files.path(f"{place}/{MARK}")
    return files.system.exists(mark) and files.text(mark).strip() == kind


def _kept_clear(files: _Files, place, kind: str) -> bool:
    """Whether a folder of this kind is there; anything else that is there is refused. What a broken replacement put aside comes back first."""
    aside = files.path(f"{place.getParent()}/.{place.getName()}.before")
    if files.status(place) is None and files.status(aside) is not None:
        files.system.rename(aside, place)
    found = files.status(place)
    if found is None:
        return False
    if not found.isDirectory() or (not _own(files, place, kind) and files.system.listStatus(place)):
        raise PathNotAllowed(f"{place} is there and is no {kind}")
    return True


def write_table(frame: DataFrame, root: str, target: str, kind: str, form: str = "parquet") -> str:
    """Replaces the folder of a table below ``root``; a folder that is no ``kind`` of this module's is refused.

    The new rows are written beside it first. Only then does the old folder step aside, and the new one takes its name; a
    run that broke in between is completed by the next one, or by ``settle``.
    """
    spark = frame.sparkSession
    files = _Files(spark, root)
    place = _target(files, root, target)
    there = _kept_clear(files, place, kind)
    waiting, aside = f"{place.getParent()}/.{place.getName()}.{uuid.uuid4().hex}", files.path(f"{place.getParent()}/.{place.getName()}.before")
    try:
        frame.write.format(form).save(waiting)
        files.write(files.path(f"{waiting}/{MARK}"), [kind.encode()])
        if there:
            files.system.delete(aside, True)
            files.system.rename(place, aside)
        if not files.system.rename(files.path(waiting), place):
            raise OSError(f"{place} could not be put in place")
    except BaseException:
        files.system.delete(files.path(waiting), True)
        if files.status(place) is None and files.status(aside) is not None:
            files.system.rename(aside, place)
        raise
    files.system.delete(aside, True)
    return str(place)


def settle(spark: SparkSession, root: str, target: str, kind: str) -> bool:
    """Brings back what a broken ``write_table`` put aside; whether a table is there."""
    files = _Files(spark, root)
    return _kept_clear(files, _target(files, root, target), kind)


def append_records(records: DataFrame, root: str, target: str, kind: str = "scan log", required: tuple[str, ...] = ("commit",)) -> str:
    """Appends rows as JSON lines to a log below ``root``, which is made if it is not there.

    A folder without a mark is taken over only if each of its lines is a JSON object with the ``required`` keys; else it is someone else's and refused.
    """
    spark = records.sparkSession
    files = _Files(spark, root)
    place = _target(files, root, target)
    found = files.status(place)
    if found is not None and not found.isDirectory():
        raise PathNotAllowed(f"{place} is there and is no {kind}")
    mark = files.path(f"{place}/{MARK}")
    if found is not None and files.system.exists(mark):
        if not _own(files, place, kind):
            raise PathNotAllowed(f"{place} is there and is no {kind}")
    elif found is not None and files.system.listStatus(place):
        whole = F.lit(True)
        for key in required:
            whole = whole & F.get_json_object("value", f"$['{key}']").isNotNull()
        foreign = spark.read.option("recursiveFileLookup", True).text(str(place)).filter("trim(value) != ''").filter(~F.coalesce(whole, F.lit(False))).limit(1)
        if not foreign.isEmpty():
            raise PathNotAllowed(f"{place} is there and is no {kind}")
    records.write.mode("append").option("ignoreNullFields", False).json(str(place))
    if not files.system.exists(mark):
        files.write(mark, [kind.encode()])
    return str(place)


def ordered_document(rows: DataFrame, order: list, root: str, target: str, value: str = "value", head: str = "", foot: str | Iterable[bytes] = "", between: str = "\n") -> str:
    """One file of the texts of ``rows`` in their order, with ``between`` between them: written by ranges of rows in parallel, then joined.

    No task holds more than its range, and the driver a MB: parts are copied one behind the other in the order of their
    ranges into a file beside the target, which takes its place at the end. Null texts are left out. ``foot`` may come in blocks.
    """
    spark = rows.sparkSession
    files = _Files(spark, root)
    place = _target(files, root, target)
    parts = f"{place.getParent()}/.{place.getName()}.parts-{uuid.uuid4().hex}"
    try:
        ranged = rows.filter(F.col(value).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
        ranged.select(F.concat(F.lit(between), F.col(value)).alias("value")).write.option("lineSep", "\u0000").text(parts)
        names = sorted(x.getPath().getName() for x in files.system.listStatus(files.path(parts)) if x.getPath().getName().startswith("part-"))

        def blocks():
            yield head.encode()
            skip = len(between.encode())  # the first text has nothing before it
            for name in names:
                stream = files.system.open(files.path(f"{parts}/{name}"))
                try:
                    while chunk := bytes(files.jvm.org.apache.commons.io.IOUtils.toByteArray(files.jvm.org.apache.commons.io.input.BoundedInputStream(stream, 1 << 20))):
                        yield chunk[skip:].replace(b"\0", b"")
                        skip = max(0, skip - len(chunk))
                finally:
                    stream.close()
            yield from [foot.encode()] if isinstance(foot, str) else foot

        return write_text(spark, root, target, blocks())
    finally:
        files.system.delete(files.path(parts), True)
