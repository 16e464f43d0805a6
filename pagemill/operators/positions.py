"""Texts as their tokens, cut once, and tokens of them replaced.

What is found out about a token is found out once for the corpus. Only tokens
that are replaced come back to the texts that have them, as one short list each;
a text stays whole in its row and is put together again where it is.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text
from ..plans.tables import ensure_checkpoint_dir


def cut(rows: DataFrame, key: str, column: str = "text", tokens: Callable[[Column], Column] = text.token_text) -> DataFrame:
    """(key, tokens: joined by spaces), cut from its lineage, as it is read several times."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.select(key, tokens(F.col(column)).alias("tokens")).checkpoint()


def distinct(texts: DataFrame) -> DataFrame:
    """(token) of all texts."""
    return texts.select(F.explode(F.split("tokens", " ")).alias("token")).where("token <> ''").distinct()


def counted(texts: DataFrame) -> DataFrame:
    """(token, n) of all texts."""
    return texts.select(F.explode(F.split("tokens", " ")).alias("token")).where("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


#: Tokens are frequent that make up more than this part of all tokens each; so there are fewer than so many.
FREQUENT = 200_000


def frequent(tokens: DataFrame) -> DataFrame:
    """The frequent ones of (token, n, ...); few enough for a broadcast, though most of all texts."""
    total = tokens.agg(F.sum("n")).first()[0] or 0
    return tokens.where(F.col("n") * FREQUENT > total)


def _without(each: DataFrame, same: DataFrame | None) -> DataFrame:
    return each if same is None else each.join(F.broadcast(same.select("token")), "token", "left_anti")


def places(texts: DataFrame, key: str, same: DataFrame | None = None) -> DataFrame:
    """(key, pos, token): a row for each token of each text, but for ``same``, which are :func:`frequent` ones."""
    return _without(texts.where("tokens <> ''").select(key, F.posexplode(F.split("tokens", " ")).alias("pos", "token")), same)


def with_changes(texts: DataFrame, key: str, changes: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """Add ``changes``: the (token, value) of a table that a text has, as lines; null where it has none.

    The table has a row for each token, of any number, and no spaces in it.
    ``same`` are :func:`frequent` tokens that it doesn't have: these don't move.
    """
    each = _without(texts.where("tokens <> ''").select(key, F.explode(F.array_distinct(F.split("tokens", " "))).alias("token")), same)
    found = each.join(changes.select("token", "value"), "token")
    lines = found.groupBy(key).agg(F.array_join(F.collect_list(F.concat("token", F.lit(" "), "value")), "\n").alias("changes"))
    return texts.join(lines, key, "left")


def changed(lines: str | None) -> dict[str, str]:
    """The lines of :func:`with_changes`."""
    return dict(x.split(" ") for x in lines.split("\n")) if lines else {}


def _glued(tokens: pa.Array, changes: pa.Array) -> pa.Array:
    out = []
    for t, lines in zip(tokens.to_pylist(), changes.to_pylist(), strict=True):
        parts, new = (t or "").split(" "), changed(lines)
        out.append("".join(map(text.SPACED.__getitem__, [new.get(x, x) for x in parts] if new else parts)).strip(" "))
    return pa.array(out, pa.string())


def replaced(texts: DataFrame, key: str, changes: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """(key, text) of all texts: tokens with their new values, signs glued to what stands before; an empty value drops a token."""
    put = F.arrow_udf(_glued, StringType())
    return with_changes(texts, key, changes, same).select(key, put("tokens", "changes").alias("text"))
