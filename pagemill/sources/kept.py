"""Dictionaries that outlive a session: versions in a folder, and a log of which one holds.

A change writes a whole version into a folder of its own and then puts an entry
with the next number into the log, by a rename that fails where that number is
taken. Readers follow the last entry, so they see a version whole or not at
all, whatever became of its writer; of two writers one gets the number, and the
other makes its change again on what the first one left. The folder has to be
in a store whose rename is atomic, as HDFS's is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from . import lists

#: What an entry of the log names where nothing of one's own holds, but the base dictionary.
BASE = "base"

Change = Callable[[DataFrame | None], DataFrame | None]


class Conflict(RuntimeError):
    """Other writers were faster, as often as tried."""


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _store(spark: SparkSession, folder: str):
    return _path(spark, folder).getFileSystem(spark._jsc.hadoopConfiguration())


def last(spark: SparkSession, folder: str) -> tuple[int, str]:
    """(number, version) of the last entry; (0, ``BASE``) where there is none."""
    store, log = _store(spark, folder), _path(spark, folder, "log")
    numbers = [x.getPath().getName() for x in store.listStatus(log)] if store.exists(log) else []
    found = max((int(n) for n in numbers if n.isdigit()), default=0)
    if not found:
        return 0, BASE
    stream = store.open(_path(spark, folder, "log", f"{found:08d}"))
    try:
        return found, spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _version(spark: SparkSession, folder: str, version: str) -> DataFrame | None:
    return None if version == BASE else lists.dictionary(spark, f"{folder}/versions/{version}")


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """(word, freq) of the version that holds; None where the base dictionary does."""
    return _version(spark, folder, last(spark, folder)[1])


def _enter(spark: SparkSession, folder: str, number: int, version: str) -> bool:
    """Whether the entry got its number: written whole under another name, then renamed."""
    jvm, store = spark._jvm, _store(spark, folder)
    draft = _path(spark, folder, "log", f".{uuid.uuid4().hex}")
    out = store.create(draft, False)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(store.makeQualified(draft), store.makeQualified(_path(spark, folder, "log", f"{number:08d}")), no_overwrite)
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        store.delete(draft, False)


def update(spark: SparkSession, folder: str, change: Change, tries: int = 10) -> DataFrame | None:
    """Apply ``change`` to what holds and keep the result; None for either stands for the base.

    Where another writer was faster, the change is made again on its version.
    A version that lost stays in no log and is deleted.
    """
    for _ in range(tries):
        number, version = last(spark, folder)
        made, name = change(_version(spark, folder, version)), BASE
        if made is not None:
            name = f"{number + 1:08d}-{uuid.uuid4().hex}"
            lists.write_dictionary(made, f"{folder}/versions/{name}")
        if _enter(spark, folder, number + 1, name):
            return _version(spark, folder, name)
        if made is not None:
            _store(spark, folder).delete(_path(spark, folder, "versions", name), True)
    raise Conflict(f"{folder}: {tries} times another writer was faster")


def revert(spark: SparkSession, folder: str) -> None:
    """Let the base dictionary hold; earlier versions stay in their folders."""
    update(spark, folder, lambda found: None)
