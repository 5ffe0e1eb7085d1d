"""Declarations of a changing tree: only texts that no audit before has parsed are parsed, the others' rows come from a store.

The store is a folder of generations: ``gen=N`` holds rows, ``gen=N.done`` says with which digest of the code they were made
and that they are whole. A generation without its mark, left by a broken run, is never read; one made by other code is
not either.
"""

from __future__ import annotations

import hashlib
import inspect
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import declarations as recognisers
from ..functions import lexing, streams
from . import code, complexity


def code_digest() -> str:
    """Digest of all the code that makes rows of declarations."""
    return hashlib.sha256("\0".join(inspect.getsource(m) for m in (recognisers, lexing, streams, code, complexity)).encode()).hexdigest()


def _system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def generations(spark: SparkSession, store: str, digest: str) -> list[int]:
    """The whole generations of a store that code of this digest made, oldest first; none if there is no store."""
    path, system = _system(spark, store)
    if not system.exists(path):
        return []
    names = {x.getPath().getName() for x in system.listStatus(path)}
    found = sorted(int(n[4:].split(".")[0]) for n in names if n.startswith("gen=") and n.endswith(f".{digest[:32]}.done"))
    return [n for n in found if f"gen={n}" in names]


def _commit(rows: DataFrame, store: str, number: int, digest: str) -> str:
    """Writes a generation beside its place, renames it there, then sets its mark; returns its folder. A place that is taken already raises."""
    spark = rows.sparkSession
    waiting, place = f"{store}/.{uuid.uuid4().hex}", f"{store}/gen={number}"
    rows.write.parquet(waiting)
    path, system = _system(spark, place)
    if system.exists(path) or not system.rename(spark._jvm.org.apache.hadoop.fs.Path(waiting), path):
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(waiting), True)
        raise FileExistsError(f"{place}: another run has written this generation")
    system.create(spark._jvm.org.apache.hadoop.fs.Path(f"{place}.{digest[:32]}.done"), False).close()
    return place


def _next(spark: SparkSession, store: str) -> int:
    path, system = _system(spark, store)
    names = [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []
    return max([int(n[4:].split(".")[0]) for n in names if n.startswith("gen=")], default=-1) + 1


def declarations(sources: DataFrame, store: str, digest: str | None = None) -> DataFrame:
    """The rows of ``code.declarations`` for ``sources`` (path, text), equal to those of a full run.

    A text is known by its path's suffix and the 256 bits of its digest, so a file that moved is not parsed again either, nor are copies of a
    text more than once. Texts without declarations leave a row without a name in the store, so that they are known,
    too. The new generation holds what this tree needs, and so does not grow with what was deleted. Null texts have no rows.
    Digests that are made of a narrow table are taken for as small as that, so every join says that no side goes to all tasks.
    """
    spark, digest = sources.sparkSession, digest or code_digest()
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)?$", 0))
    own = sources.filter("text is not null").select("path", "text", F.sha2(F.concat_ws("\0", suffix, "text"), 256).alias("mark"), suffix.alias("suffix"))
    done = generations(spark, store, digest)
    empty = code.declarations(own.limit(0)).withColumnsRenamed({"path": "mark"})
    held = spark.read.schema(empty.schema).parquet(f"{store}/gen={done[-1]}") if done else None
    wanted = own.select("mark").distinct()
    new = own if held is None else own.join(held.select("mark").distinct().hint("merge"), "mark", "left_anti")
    # One text a digest; what is parsed is called by its digest and keeps its suffix, which names the language.
    new = new.groupBy("mark").agg(F.first(F.struct("text", "suffix")).alias("t")).select(F.concat("mark", "t.suffix").alias("path"), "t.text", "mark")
    parsed = code.declarations(new).withColumn("mark", F.substring("path", 1, 64)).drop("path")
    parsed = new.select("mark").join(parsed.hint("merge"), "mark", "left").select(empty.columns)
    rows = parsed if held is None else parsed.unionByName(held.join(wanted.hint("merge"), "mark", "left_semi"))
    place = _commit(rows, store, _next(spark, store), digest)
    kept = spark.read.schema(empty.schema).parquet(place).filter("name is not null")
    return own.select("path", "mark").join(kept.hint("merge"), "mark").drop("mark")


def forget(spark: SparkSession, store: str, keep: int = 1) -> None:
    """Deletes all but the newest ``keep`` generations of each digest of the code, and what broken runs left."""
    path, system = _system(spark, store)
    if not system.exists(path):
        return
    names = {x.getPath().getName() for x in system.listStatus(path)}
    marks = [(int(n[4:].split(".")[0]), n.split(".")[1]) for n in names if n.startswith("gen=") and n.endswith(".done")]
    newest = {n for d in {d for _, d in marks} for n in sorted((n for n, own in marks if own == d), reverse=True)[:keep]}
    for name in names:
        if not name.startswith("gen=") or int(name[4:].split(".")[0]) not in newest:
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}"), True)


def remembered(spark: SparkSession, store: str, commit: str, make: Callable[[], dict[str, DataFrame]], digest: str | None = None) -> tuple[dict[str, DataFrame], bool]:
    """The tables that ``make`` gives for a commit, and whether they were read from the store instead of made.

    A result is known by commit and digest of the code. It is written beside its place and renamed as a whole, with a list of its tables, so a
    run that breaks leaves nothing that is read; of two runs at once one is kept. Tables keep their columns and rows; their order is not kept.
    """
    name = hashlib.sha256(f"{commit}\0{digest or code_digest()}".encode()).hexdigest()
    path, system = _system(spark, f"{store}/result={name}")
    made = not system.exists(path)
    if made:
        waiting = f"{store}/.{uuid.uuid4().hex}"
        tables = make()
        for table, frame in tables.items():
            frame.write.parquet(f"{waiting}/{table}")
        spark.createDataFrame([(commit, t) for t in sorted(tables)], "commit string, table string").coalesce(1).write.json(f"{waiting}/_tables")
        if system.exists(path) or not system.rename(spark._jvm.org.apache.hadoop.fs.Path(waiting), path):
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(waiting), True)
    names = [x.getPath().getName() for x in system.listStatus(path)]
    return {t: spark.read.parquet(f"{store}/result={name}/{t}") for t in sorted(names) if not t.startswith(("_", "."))}, not made


def missing(spark: SparkSession, store: str, commits: DataFrame, digest: str | None = None) -> DataFrame:
    """Those of ``commits`` (commit) of which the store has no result of this code, as an anti-join."""
    path, system = _system(spark, store)
    done = [x.getPath().getName()[7:] for x in system.listStatus(path) if x.getPath().getName().startswith("result=")] if system.exists(path) else []
    known = spark.createDataFrame([(d,) for d in done], "_name string")
    name = F.sha2(F.concat(F.col("commit"), F.lit(f"\0{digest or code_digest()}")), 256)
    return commits.withColumn("_name", name).join(known, "_name", "left_anti").drop("_name")
