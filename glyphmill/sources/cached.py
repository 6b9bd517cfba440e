"""Tables that a session makes from a source once: kept by the state of the source's files, made anew when that changes.

A load that fails is forgotten, so that the next one tries again; a few tries are made at once, for files that are being
replaced. Tables stand in the folder that driver and executors share, until they are released or the session ends.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from glyphmill.functions.shipping import shared_folder

#: How often a load is tried.
TRIES = 2


def content_mark(spark: SparkSession, path: str) -> str:
    """What names the state of a source: its path, and the names, sizes and times of all its files, in folders within folders too."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while found.hasNext():
        f = found.next()
        files.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.md5("\n".join([path, *sorted(files)]).encode()).hexdigest()


def _held(spark: SparkSession) -> dict[tuple[str, str], tuple[str, str]]:
    """(kind, source) -> (mark, table) of the session's context."""
    return spark.sparkContext.__dict__.setdefault("_glyphmill_tables", {})


def table_of(spark: SparkSession, source: str, kind: str, write: Callable[[str], None], tries: int = TRIES) -> str:
    """The path of the table of a kind that write makes from source, at a path that it is given.

    It is made on first use and when files of source have changed since. If files change while it is made, or if it
    fails, it is tried again; what the last try raises is raised, and nothing is kept.
    """
    held = _held(spark)
    for left in range(tries - 1, -1, -1):
        mark = content_mark(spark, source)
        if held.get((kind, source), ("",))[0] == mark:
            return held[kind, source][1]
        path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
        try:
            write(path)
        except Exception:
            held.pop((kind, source), None)
            _delete(spark, path)
            if not left:
                raise
            continue
        if left and content_mark(spark, source) != mark:
            _delete(spark, path)
            continue
        held[kind, source] = mark, path
        return path
    raise AssertionError("no try was left")


def release(spark: SparkSession, source: str | None = None) -> int:
    """Forgets and deletes the tables made from source, or all of them; how many there were. No plan may read them after."""
    held = _held(spark)
    gone = [k for k in held if source is None or k[1] == source]
    for k in gone:
        _delete(spark, held.pop(k)[1])
    return len(gone)


def _delete(spark: SparkSession, path: str) -> None:
    """A table, and what stands beside it under names that go on with a hyphen."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}*")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(where) or []:
        fs.delete(found.getPath(), True)
