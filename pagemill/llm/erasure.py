"""Cascading erasure from sorted Parquet files, rewriting only what holds victims.

Every table is sorted by the crc32 of its client and then by all its columns,
and cut into files of as many consecutive rows. A row's rank so tells its file.
The ranks of victims are collapsed into intervals of consecutive ranks (gaps and
islands), intervals are split where a file ends by integer division, and a file
with intervals is read as Arrow batches of which the surviving slices, without a
copy, make the new file. Other files are never opened for it.

Ranks come from a range sort by all columns, so a client with a third of all
rows is dealt over many tasks; a file is written by one task, as a stream.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import store

#: The column that a file's cents are summed over, by table.
AMOUNTS = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}
BATCH_ROWS = 65_536


@dataclass(frozen=True)
class Layout:
    """Files have ``1 + n // files`` rows; one master in ``share`` is erased."""

    files: int = 350
    share: int = 400


def crc(c: Column) -> Column:
    """crc32 of a decimal id; of the empty text for null."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def victim_masters(clients: DataFrame, clicks: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """(master_id): one in ``share`` by crc32, and the one whose clients have most clicks.

    Ties, also at no click at all, go to the smallest id. Clicks are counted by
    client before they meet the clients; a null client has no master.
    """
    owned = clients.where("master_id is not null").select("client_id", "master_id").distinct()
    counts = clicks.where("client_id is not null").groupBy("client_id").agg(F.count(F.lit(1)).alias("__n"))
    busy = owned.join(counts, "client_id", "left").groupBy("master_id").agg(F.sum(F.coalesce("__n", F.lit(0))).alias("__n"))
    most = busy.orderBy(F.desc("__n"), "master_id").limit(1).select("master_id")
    dealt = owned.where(crc(F.col("master_id")) % layout.share == 0).select("master_id")
    return dealt.unionByName(most).distinct()


@dataclass
class Sorted:
    """A table in its order: rows have the task ``__p`` and the place ``__i`` in it; ``before`` tells the rows of earlier tasks."""

    rows: DataFrame
    before: list[tuple[int, int]]
    n: int

    def ranked(self, df: DataFrame) -> DataFrame:
        """Add ``__rank``. There is a row of ``before`` for each task of the sort."""
        offsets = df.sparkSession.createDataFrame(self.before or [(0, 0)], "__q int, __before long")
        return df.join(F.broadcast(offsets), F.col("__p") == F.col("__q")).withColumn("__rank", F.col("__i") + F.col("__before")).drop("__q", "__before")


def in_order(table: DataFrame, name: str, owner: DataFrame | None = None) -> Sorted:
    """The table by the crc32 of its client, then all columns, ascending, nulls first.

    ``owner`` (sale_id, client_id) tells the client where the table has none; an
    id that it lists twice counts by its smallest client. Equal rows are in any order.
    """
    columns = [F.col(f"`{c}`").asc_nulls_first() for c in table.columns]
    if owner is None:
        keyed = table.withColumn("__crc", crc(F.col("client_id")))
    else:  # a frequent sale is split by AQE: its side has one row
        one = owner.where("sale_id is not null").groupBy(F.col("sale_id").alias("__sale")).agg(F.min("client_id").alias("__client"))
        keyed = table.join(one, F.col("sale_id") == F.col("__sale"), "left").withColumn("__crc", crc(F.col("__client"))).drop("__sale", "__client")
    sort = [F.col("__crc"), *columns]
    dealt = keyed.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("__crc")
    mask = (1 << 33) - 1
    rows = store.written(dealt.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND(F.lit(mask)).alias("__i")), f"sorted-{name}")
    sizes = sorted(tuple(r) for r in rows.groupBy("__p").agg(F.count(F.lit(1))).collect())  # a row for each task
    ends = list(itertools.accumulate((n for _, n in sizes), initial=0))
    return Sorted(rows, [(p, at) for (p, _), at in zip(sizes, ends, strict=False)], ends[-1])


def write_files(table: Sorted, folder: str, columns: list[str], size: int) -> dict[int, str]:
    """Write files of ``size`` consecutive ranks into ``folder``; their paths by number.

    Spark writes them into folders by number, from which the driver moves them,
    so that no reader takes a folder's name for a column.
    """
    number = "file_no"
    while number in columns:
        number += "_"
    spark, beside = table.rows.sparkSession, f"{folder}-written"
    rows = table.ranked(table.rows).withColumn(number, F.expr(f"cast(__rank div {size} as int)"))
    dealt = rows.repartitionById(-(-table.n // size), F.col(number)).sortWithinPartitions(number, "__rank")
    dealt.select(*(F.col(f"`{c}`") for c in columns), number).write.partitionBy(number).parquet(beside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    out = {}
    for at in (s.getPath() for s in fs.listStatus(path(beside)) if s.isDirectory()):  # a folder for each file, which the layout bounds
        (made,) = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet")]
        i = int(at.getName().partition("=")[2])
        out[i] = f"{folder}/{i:05d}.parquet"
        if not fs.rename(made, path(out[i])):
            raise OSError(f"{made} could not be moved to {out[i]}")
    store.drop(spark, beside)
    return out


def intervals(table: Sorted, victims: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(file_no, first, last): runs of victims' places in each file.

    ``victims`` has distinct values of ``keys``. Islands are found among the
    ranks of one task of the sort; where one spans a border of tasks it comes as
    two, which changes no result.
    """
    hit = table.rows.select(*keys, "__p", "__i").join(victims, keys, "left_semi").select("__p", "__i")
    gap = F.col("__i") - F.row_number().over(W.partitionBy("__p").orderBy("__i"))
    runs = hit.withColumn("__gap", gap).groupBy("__p", "__gap").agg(F.min("__i").alias("__i"), F.count(F.lit(1)).alias("__n"))
    runs = table.ranked(runs).select(F.col("__rank").alias("low"), (F.col("__rank") + F.col("__n") - 1).alias("high"))
    split = runs.select("low", "high", F.explode(F.expr(f"sequence(low div {size}, high div {size})")).alias("file_no"))
    start = F.col("file_no") * F.lit(size)
    return split.select("file_no", (F.greatest("low", start) - start).alias("first"), (F.least(F.col("high"), start + (size - 1)) - start).alias("last"))


def _opened(path: str):
    """A store and the path in it; what tasks open must be a store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def survivors(batches: Iterable[pa.RecordBatch], gone: Iterable[tuple[int, int]]) -> Iterator[list[pa.RecordBatch]]:
    """Of each batch the slices outside the intervals, which ascend and do not overlap."""
    spans = iter(gone)
    end_of_all = (1 << 62, 1 << 62)
    low, high = next(spans, end_of_all)
    at = 0
    for batch in batches:
        begin, end, kept = at, at + batch.num_rows, []
        while low < end:
            if low > begin:
                kept.append(batch.slice(begin - at, low - begin))
            begin = min(high + 1, end)
            if high >= end:  # goes on in the next batch
                break
            low, high = next(spans, end_of_all)
        if begin < end:
            kept.append(batch.slice(begin - at, end - begin))
        at = end
        yield kept


def rewrite(source: str, target: str, staged: str, gone: Iterable[tuple[int, int]]) -> int:
    """Write the rows of ``source`` outside the intervals to ``target``; their number.

    The file is made under another name and then moved, so a task that runs
    again or is lost leaves no half file. Without survivors there is no file.
    """
    fs, path = _opened(source)
    _, to = _opened(target)
    _, beside = _opened(f"{staged}/{uuid.uuid4().hex}")
    n, held, waiting, writer = 0, [], 0, None
    with fs.open_input_file(path) as file:
        reader = pq.ParquetFile(file)
        schema = reader.schema_arrow

        def flush() -> None:
            nonlocal held, waiting, writer
            if held:
                writer = writer or pq.ParquetWriter(beside, schema, filesystem=fs, compression="snappy")
                writer.write_table(pa.Table.from_batches(held, schema))
                held, waiting = [], 0

        for kept in survivors(reader.iter_batches(BATCH_ROWS), gone):
            held += kept
            waiting += sum(b.num_rows for b in kept)
            n += sum(b.num_rows for b in kept)
            if waiting >= BATCH_ROWS:
                flush()
        flush()
    if writer:
        writer.close()
        fs.move(beside, to)
    return n


def described(path: str, amount: str) -> tuple[int, int, str, str]:
    """Rows, cents, digest of the first column and column names of a file, read as a stream."""
    fs, at = _opened(path)
    cents, digest, rows = 0, hashlib.sha256(), 0
    with fs.open_input_file(at) as file:
        reader = pq.ParquetFile(file)
        names = reader.schema_arrow.names
        for batch in reader.iter_batches(BATCH_ROWS, columns=list(dict.fromkeys([names[0], amount]))):
            x = batch.column(names.index(amount) and 1).cast(pa.float64()).fill_null(0.0).to_numpy()
            cents += sum(np.floor(100 * x + 0.5).astype(np.int64).tolist())
            ids = ",".join("" if v is None else str(v) for v in batch.column(0).to_pylist())
            digest.update((("," if rows else "") + ids).encode())
            rows += batch.num_rows
        return reader.metadata.num_rows, cents, digest.hexdigest(), ",".join(names)


_RESULT = "table_name string, file_no long, n_rows long, n_erased long, cents long, rewritten boolean, ids_sha256 string, columns string, path string"


def _rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["table_name", "file_no", "source", "target", "n_rows"]
    for key, run in itertools.groupby(_rows_of(batches), key=lambda r: r[:5]):
        n = rewrite(*key[2:5], ((r[5], r[6]) for r in run))
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*key[:4], n), strict=True))], pa.schema([("table_name", pa.string()), ("file_no", pa.int64()), ("source", pa.string()), ("target", pa.string()), ("n_rows", pa.int64())]))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("table_name", pa.string()), ("file_no", pa.int64()), ("n_rows", pa.int64()), ("n_erased", pa.int64()), ("cents", pa.int64()), ("rewritten", pa.bool_()), ("ids_sha256", pa.string()), ("columns", pa.string()), ("path", pa.string())])
    for name, number, n_erased, done, path, shown in _rows_of(batches):
        n, cents, ids, columns = described(path, AMOUNTS[name])
        row = (name, number, n, n_erased, cents, done, ids, columns, shown)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema)


def _plain(path: str) -> str:
    """A local file by its path, others by their address."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def erased(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame, folder: str, layout: Layout = Layout()) -> DataFrame:
    """Write the four tables as sorted files under ``folder``, erase the victims; a row for each final file.

    Victims are the clients' rows of :func:`victim_masters`, clicks and sales of
    these clients, and lines of these sales. Null ids own nothing and belong to
    nobody. A sale id of several sales is erased from the lines if one of its
    sales is. Repeated rows each have a rank of their own. Extra columns of any
    name stay in the files. A table without rows has no file.

    Only numbers of files, at most ``layout.files`` a table, come to the driver.
    Old files go when all new ones are there; the query's run is over then, so a
    lost executor finds what it reads. Result rows are read from the files.
    """
    spark = clients.sparkSession
    tables = {"clients": clients, "clicks": clicks, "sales": sales, "sale_lines": sale_lines}
    files: list[tuple] = []
    with store.scope():
        held = {name: in_order(df, name, sales.select("sale_id", "client_id") if name == "sale_lines" else None) for name, df in tables.items()}
        masters = store.written(victim_masters(clients, clicks, layout), "masters")
        owned = store.written(clients.join(masters, "master_id", "left_semi").where("client_id is not null").select("client_id").distinct(), "victim-clients")
        sold = store.written(sales.join(owned, "client_id", "left_semi").where("sale_id is not null").select("sale_id").distinct(), "victim-sales")
        gone = None
        for name, (victims, key) in {"clients": (masters, "master_id"), "clicks": (owned, "client_id"), "sales": (owned, "client_id"), "sale_lines": (sold, "sale_id")}.items():
            table, size = held[name], 1 + held[name].n // layout.files
            if not table.n:
                continue
            paths = write_files(table, f"{folder}/{name}", tables[name].columns, size)
            files += [(name, i, path, min(size, table.n - i * size)) for i, path in sorted(paths.items())]
            some = intervals(table, victims, [key], size).select(F.lit(name).alias("table_name"), "file_no", "first", "last")
            gone = some if gone is None else gone.unionByName(some)
        done = []
        if gone is not None:
            staged = f"{folder}/_staged"
            listed = spark.createDataFrame([(name, i, path, f"{path.removesuffix('.parquet')}-rewritten.parquet", staged) for name, i, path, _ in files], "__table string, __no long, source string, target string, staged string")
            _folder(spark, staged)
            # a row for each file
            work = gone.join(F.broadcast(listed), (F.col("table_name") == F.col("__table")) & (F.col("file_no") == F.col("__no")))
            work = work.repartition(_tasks(spark, len(files)), "table_name", "file_no").sortWithinPartitions("table_name", "file_no", "first")
            work = work.select("table_name", "file_no", "source", "target", "staged", "first", "last")
            done = work.mapInArrow(store.worker_task("erasure")(_rewritten), "table_name string, file_no long, source string, target string, n_rows long").collect()
            for r in done:
                store.drop(spark, r.source)
            store.drop(spark, staged)
    new = {(r.table_name, r.file_no): (r.target, r.n_rows) for r in done}
    final = []
    for name, i, path, rows in files:
        path, left = new.get((name, i), (path, rows))
        if left:
            final.append((name, i, rows - left, (name, i) in new, path, _plain(path)))
    shown = spark.createDataFrame(final, "table_name string, file_no long, n_erased long, rewritten boolean, path string, shown string")
    return shown.repartition(_tasks(spark, len(final)), "path").mapInArrow(store.worker_task("erasure")(_described), _RESULT)


def _tasks(spark: SparkSession, files: int) -> int:
    """Two tasks a core, a file each at least: rows are few and small but stand for files, so AQE must not put them together."""
    return max(1, min(files, 2 * spark.sparkContext.defaultParallelism))


def _folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own under ``spark.checkpoint.dir``, which stays."""
    return f"{store.checkpoint_dir(spark)}/erased-{uuid.uuid4().hex}"
