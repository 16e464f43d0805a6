"""Tables cut from their lineage, and what Python workers keep between tasks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import json
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OPEN: dict[str, SparkSession] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Only where it is unset and the session runs in one process, as in tests, a
    local folder is made and set; on a cluster that would scatter tables.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Scope:
    """Tables written inside are dropped at the end, also after an error.

    Those that :meth:`keep` names pass to the scope around.
    """

    def __init__(self):
        self.made: dict[str, SparkSession] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Let the table that ``df`` was read from by :func:`written` outlive the scope."""
        path = _PATHS[id(df)][1]
        spark = self.made.pop(path)
        if len(_SCOPES) > 1:
            _SCOPES[-2].made[path] = spark
        return df


_SCOPES: list[Scope] = []
_PATHS: dict[int, tuple[DataFrame, str]] = {}


@contextlib.contextmanager
def scope() -> Iterator[Scope]:
    held = Scope()
    _SCOPES.append(held)
    try:
        yield held
    finally:
        _SCOPES.remove(held)
        for path, spark in held.made.items():
            with contextlib.suppress(Exception):
                drop(spark, path)


def _drop_all() -> None:
    for path, spark in list(_OPEN.items()):
        with contextlib.suppress(Exception):
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`written`."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _OPEN.pop(path, None)
    for key in [k for k, (_, held) in _PATHS.items() if held == path]:
        del _PATHS[key]


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def forget(df: DataFrame) -> None:
    """Drop the table that ``df`` was read from by :func:`written`, if it still is there."""
    if id(df) in _PATHS:
        path = _PATHS[id(df)][1]
        for held in _SCOPES:
            held.made.pop(path, None)
        drop(df.sparkSession, path)


def _new(spark: SparkSession, name: str) -> str:
    path = f"{checkpoint_dir(spark)}/pagemill/{name}-{uuid.uuid4().hex}"
    if not _OPEN:
        atexit.register(_drop_all)
    _OPEN[path] = spark
    if _SCOPES:
        _SCOPES[-1].made[path] = spark
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    The result depends on files alone, so a lost executor costs no
    recomputation of what came before. The folder goes at the end of the
    :func:`scope` around, with :func:`forget`, or when Python ends.
    """
    spark = df.sparkSession
    path = _new(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


def lines_table(spark: SparkSession, rows: list[dict], schema: str, name: str) -> DataFrame:
    """A small table of the driver's as JSON lines in the checkpoint folder.

    Only SQL functions make it. As a file it is scanned like any other table;
    as a literal it would swell the plan.
    """
    path = _new(spark, name)
    spark.range(1).select(F.lit("\n".join(map(json.dumps, rows))).alias("value")).write.text(path)
    return spark.read.schema(schema).json(path)


_CACHE = "_pagemill_worker_cache"


def worker_cache(key: object, build: Callable[[], object]) -> object:
    """A value kept for the life of this Python process.

    Functions that are pickled by value get fresh globals for each task, so
    that what is costly to build lives in a module of its own. A process serves
    one operator after another; :func:`worker_task` drops what earlier ones
    have left.
    """
    held = sys.modules.setdefault(_CACHE, types.ModuleType(_CACHE)).__dict__.setdefault("values", {})
    if key not in held:
        held[key] = build()
    return held[key]


def give_back() -> None:
    """Return free memory to the system, where that is possible."""
    import pyarrow as pa

    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes that tasks of a worker read and give until it gives back what they have freed.
GIVE_BACK_BYTES = 4 << 20


def worker_task(name: str) -> Callable:
    """Decorate the function of a mapInArrow: only ``name`` keeps values between tasks.

    Workers stay alive between tasks and jobs, and executors have bounded
    memory; so a task also gives back what it has freed. That takes a twentieth
    of a second, longer than many a small task, so these do it together.
    """

    def wrap(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
        def run(batches: Iterator) -> Iterator:
            module = sys.modules.setdefault(_CACHE, types.ModuleType(_CACHE))
            if module.__dict__.get("owner") != name:
                module.__dict__.get("values", {}).clear()
                module.__dict__["owner"] = name
                give_back()

            def passed(rows: Iterator) -> Iterator:
                for batch in rows:
                    moved[0] += getattr(batch, "nbytes", GIVE_BACK_BYTES)
                    yield batch

            moved = module.__dict__.setdefault("moved", [0])
            try:
                yield from passed(task(passed(batches)))
            finally:
                if moved[0] >= GIVE_BACK_BYTES:
                    give_back()
                    moved[0] = 0

        return run

    return wrap
