"""Commands on the kept dictionary: train, build, merge, shrink.

``python -m pagemill.plans.dictionaries FOLDER [--base FILE] -t TITLES | -b [FILE] | -m [FILE] | -s [FILE]``
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dictionary as dic
from ..sources import kept, lists, sinks, wiki

#: The folder of a dictionary's kept versions stands beside it.
KEPT = ".kept"


def edited(spark: SparkSession, path: str, base: DataFrame | None, add: str | None = None, remove: str | None = None, revert: bool = False) -> DataFrame | None:
    """The dictionary at ``path`` as it holds, after the edits, which are kept for later runs.

    Reverting comes before the edits. ``base`` is what holds where nothing is kept.
    """
    folder = path.rstrip("/") + KEPT
    if revert:
        kept.revert(spark, folder)
    if add or remove:
        def change(found: DataFrame | None) -> DataFrame:
            words = base if found is None else found
            if words is None:
                raise ValueError(f"there is no dictionary at {path}")
            words = dic.add(words, add) if add else words
            return dic.remove(words, remove.split()) if remove else words

        return kept.update(spark, folder, change)
    found = kept.current(spark, folder)
    return base if found is None else found


def trained(spark: SparkSession, path: str) -> DataFrame:
    """The words of a text file or folder of text files, read by lines."""
    return dic.train(spark.read.text(path), "value")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, fetch: wiki.Fetch | None = None) -> int:
    """Command line; exactly one command, whose result holds from then on.

    ``-t`` trains on wiki pages and merges with the base, ``-b`` trains on a
    text, ``-m`` merges a dictionary with the base, ``-s`` drops words that
    occur once. ``-m`` and ``-s`` without a file take what is kept.
    """
    parser = argparse.ArgumentParser(prog="pagemill.plans.dictionaries", allow_abbrev=False)
    parser.add_argument("path", help="the dictionary; its versions are kept beside it")
    parser.add_argument("--base", help="the standard dictionary, else the file at path")
    one = parser.add_mutually_exclusive_group(required=True)
    one.add_argument("-t", "--train", nargs="+", metavar="TITLE")
    one.add_argument("-b", "--build", metavar="TEXT")
    one.add_argument("-m", "--merge", nargs="?", const="", metavar="FILE")
    one.add_argument("-s", "--shrink", nargs="?", const="", metavar="FILE")
    o = parser.parse_args(sys.argv[1:] if arguments is None else arguments)
    spark = spark or SparkSession.builder.appName("pagemill").getOrCreate()
    standard = lists.dictionary(spark, o.base or o.path) if o.base or sinks.exists(spark, o.path) else None

    def change(found: DataFrame | None) -> DataFrame:
        if o.build:
            return trained(spark, o.build)
        if o.train:
            topics = [t.replace("_", " ") for t in o.train]
            found = wiki.topic_dictionary(spark, topics, fetch or wiki.http_fetch(), large=True)
        named = o.merge or o.shrink
        words = lists.dictionary(spark, named) if named else found if found is not None else standard
        if words is None:
            raise ValueError(f"there is no dictionary at {o.path}")
        if o.shrink is not None:
            return dic.shrink(words, 1)
        return dic.merge(words, standard) if standard is not None and words is not standard else words

    try:
        made = kept.update(spark, o.path.rstrip("/") + KEPT, change)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    print(made.agg(F.count(F.lit(1)).alias("words"), F.sum("freq").alias("total")).first().asDict())
    return 0


if __name__ == "__main__":
    sys.exit(main())
