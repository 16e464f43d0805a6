"""CSV files as a spreadsheet writes them, reports, and their names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def base_name(path: str, given: str | None = None) -> str:
    """The name without folder and extension, or the one given."""
    last = path.rstrip("/").rpartition("/")[2]
    return given or (last.rpartition(".")[0] or last)


def write_csv(rows: DataFrame, folder: str) -> None:
    """Part files with header, CRLF and doubled quotes, as many as partitions."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(folder)


def _quoted(name: str):
    c = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def line(rows: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A row's values as a line of CSV."""
    return F.concat_ws(",", *map(_quoted, columns or rows.columns))


def quoted(values: Sequence[str]) -> str:
    """A line of CSV, without its end."""
    return ",".join('"' + v.replace('"', '""') + '"' if any(c in v for c in '",\r\n') else v for v in values)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI that Spark and pyarrow both read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath()
    scheme = at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().toString()
    return f"{scheme.rstrip('/')}{found}" if not scheme.startswith("file:") else f"file://{found}"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """A store and the path in it; a name may have signs that a URI cannot."""
    if uri.startswith("file://"):
        return fs.LocalFileSystem(), uri.removeprefix("file://")
    scheme, _, rest = uri.partition("://")
    host, _, path = rest.partition("/")
    store, root = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return store, f"{root.rstrip('/')}/{path}"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each (folder, target, head): the head and the folder's parts in order, as one file.

    Parts are streamed under a name of the attempt's own and moved when they are
    complete, so that a lost or doubled task leaves no half file.
    """
    for batch in batches:
        for row in batch.to_pylist():
            (store, folder), (_, target) = _store(row["folder"]), _store(row["target"])
            found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            parts = sorted((int(x.base_name.split("-")[1]), x.path) for x in found if x.base_name.startswith("part-"))
            above, _, name = target.rpartition("/")
            attempt = f"{above}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(attempt) as out:
                out.write(row["head"].encode())
                for _, part in parts:
                    with store.open_input_stream(part) as source:
                        while held := source.read(1 << 22):
                            out.write(held)
            store.move(attempt, target)
        yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})


def _stage(spark: SparkSession, path: str) -> str:
    above, _, name = qualified(spark, path).rpartition("/")
    return f"{above}/.{name}.stage-{uuid.uuid4().hex}"


def write_one(rows: DataFrame, path: str, title: str | None = None, header: bool = True, raw: bool = False) -> None:
    """One CSV file under its own name, rows in the order of the table.

    With ``raw``, the only column has whole lines already and no title.

    Executors write the lines in parts; one task then joins the parts as a
    stream. Nothing goes through the driver. The folder has to be in a store
    that pyarrow knows.
    """
    spark = rows.sparkSession
    stage = _stage(spark, path)
    head = ("" if title is None else quoted([title]) + "\r\n") + (quoted(rows.columns) + "\r\n" if header and not raw else "")
    try:
        rows.select(F.col(rows.columns[0]) if raw else line(rows)).write.option("lineSep", "\r\n").text(stage)
        spark.createDataFrame([(stage, qualified(spark, path), head)], "folder string, target string, head string").mapInArrow(_joined, "n long").collect()
    finally:
        drop(spark, stage)


def write_each(lines: DataFrame, targets: DataFrame, order: Sequence[str], head: str = "", tasks: int = 64, watch: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """A file for each target: ``head``, then its lines in order.

    ``lines`` has ``file`` (int), ``line`` and the columns of ``order``;
    ``targets`` has ``file`` and ``target``, one row a file, lines or none.
    Lines are sorted by ranges of (file, order), so that a large file is many
    tasks' work, and written in parts by file; then one task a file joins its
    parts as a stream. All targets are in one store.
    """
    spark = lines.sparkSession
    first = targets.select("target").first()
    if first is None:
        return
    stage = _stage(spark, first.target)
    try:
        by = ["file", *order]
        watch(lines.repartitionByRange(*by).sortWithinPartitions(*by)).select("line", "file").write.partitionBy("file").option("lineSep", "\r\n").text(stage)
        folder = F.concat(F.lit(f"{stage}/file="), F.col("file").cast("string"))
        targets.select(folder.alias("folder"), "target", F.lit(head).alias("head")).repartition(tasks, "target").mapInArrow(_joined, "n long").agg(F.sum("n")).collect()
    finally:
        drop(spark, stage)


def report_lines(report: DataFrame, name: str, order: list) -> DataFrame:
    """A report with the titles of its columns, in order."""
    columns = [F.col("word").alias("Word"), *([F.col("pos").alias("POS")] if "pos" in report.columns else []), F.col("freq").alias("Frequency")]
    return report.orderBy(*order).select(*columns)


def section_lines(report: DataFrame, sections: DataFrame, keys: Sequence[str], sort: bool = False) -> DataFrame:
    """(file, section, part, least, word, line): each section with its title, the titles of its columns, and its words.

    ``sections`` has the keys, ``file`` and ``section`` (numbers, in order) and
    ``title``, which may be null for a section without one. Words stand in
    their order, or most frequent first. A section without words has its titles.
    """
    columns = ["word", *(["pos"] if "pos" in report.columns else []), "freq"]
    top = quoted([{"word": "Word", "pos": "POS", "freq": "Frequency"}[c] for c in columns])
    titles = F.array_compact(F.array(F.struct(F.lit(0).alias("part"), _quoted("title").alias("line")), F.struct(F.lit(1).alias("part"), F.lit(top).alias("line"))))
    heads = sections.select("file", "section", "title", F.explode(titles).alias("x")).where("x.part = 1 or title is not null")
    heads = heads.select("file", "section", "x.part", F.lit(0).cast("long").alias("least"), F.lit("").alias("word"), "x.line")
    least = -F.col("freq") if sort else F.lit(0).cast("long")
    rows = report.join(sections.select(*keys, "file", "section"), list(keys))
    return heads.unionByName(rows.select("file", "section", F.lit(2).alias("part"), least.alias("least"), "word", line(report, columns).alias("line")))


SECTION_ORDER = ["section", "part", "least", "word"]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
