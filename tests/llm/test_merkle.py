"""The manifest against a plain tree, and its proofs."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pagemill.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, digest string, pos long"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(row, text) -> str:
    return h(part(row[0]), part(row[3]), part(row[2]), part(row[4]), part(text))


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root and, for each leaf, what stands left and right of it at each level."""
    paths, groups, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], leaves
    while len(nodes) > 1:
        up, held = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for i, g in enumerate(groups[at : at + 3]):
                for leaf in g:
                    paths[leaf].append(("".join(run[:i]), "".join(run[i + 1 :])))
            up.append(h(*run))
            held.append(sum(groups[at : at + 3], []))
        nodes, groups = up, held
    return nodes[0], paths


def plain(rows: list[tuple]) -> list[tuple]:
    by: dict = {}
    for row in rows:
        by.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[1]), row))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    root, above = tree([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (_, _, leaf, row), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            path, folded = path + above[k], leaf_of(row, text)
            for left, right in path:
                folded = h(left, folded, right)
            out.append((row[0], leaf, trees[s][0], root, h(*(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


def shown(df) -> list[tuple]:
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert df.columns == columns
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


ROWS = [
    *[(i, f"line {i}\nnext", "en", "hot", 9, 1, "x", 2) for i in range(40)],
    *[(100 + i, None if i == 3 else "é" * i, None, None, None, None, None, None) for i in range(5)],
    (7, "one\n", "de", "a", 4, 0, "", 0),
    (8, "", "de", "ä", 0, 0, "", 0),
    (8, "", "de", "ä", 0, 0, "", 0),
    (None, "no id\n", "de", "ä", 6, 0, "", 0),
    (9, "x" * 200_000 + "\n", "de", "z", 1, 0, "", 0),
]


@pytest.mark.parametrize("height", [1, 2, 7])
def test_equals_a_plain_tree(spark, height):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert shown(merkle.manifest(docs, height)) == plain(ROWS)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_sizes_around_powers(spark, n):
    rows = [(i, "t\n", "en", "s", 2, 0, "", 0) for i in range(n)]
    assert shown(merkle.manifest(spark.createDataFrame(rows, SCHEMA), 1)) == plain(rows)


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_third_in_one_source_is_dealt_over_blocks(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.lit(1).cast("long").alias("n_chars"))
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    assert shown(merkle.manifest(docs, 3)) == plain(rows)


def test_walk_and_fold():
    leaves = [bytes([i]) * 32 for i in range(11)]
    root, paths = merkle.walk(leaves, merkle.levels(11))
    for i, path in enumerate(paths):
        assert merkle.fold(leaves[i], i, 11, path) == (root, len(path))
        sibling_texts = [path[j : j + 32].hex() for j in range(0, len(path), 32)]
        assert merkle.verified(leaves[i].hex(), i, 11, 0, 1, sibling_texts, root.hex())
        assert not merkle.verified(leaves[(i + 1) % 11].hex(), i, 11, 0, 1, sibling_texts, root.hex())
