"""Erasure against plain lists, and the files that are left."""

import hashlib
import math
import random
import zlib
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pagemill.llm import erasure, store

SCHEMAS = {
    "clients": "client_id long, master_id long, source string, balance double, file_no int",
    "clicks": "click_id long, ts timestamp_ntz, client_id long, value double",
    "sales": "sale_id long, client_id long, total double",
    "sale_lines": "sale_id long, line_no int, amount double, `a.b` string",
}


def crc(x) -> int:
    return zlib.crc32(b"" if x is None else str(x).encode())


def made(seed: int, n: int, hot: int | None = None) -> dict[str, list[tuple]]:
    r = random.Random(seed)
    some = lambda k: None if r.random() < 0.05 else hot if hot is not None and r.random() < 0.4 else r.randrange(k)
    money = lambda: r.choice([None, -1.005, 0.005, round(r.uniform(-50, 500), 2)])
    clients = [(i, some(n // 8 + 1), r.choice(["crm", None, "web"]), money(), 3) for i in range(n // 4)]
    clicks = [(r.randrange(n), datetime(2024, 1, 1) + timedelta(seconds=r.randrange(99)), some(n // 4 + 1), money()) for _ in range(n)]
    sales = [(i, some(n // 4 + 1), money()) for i in range(n)]
    lines = [(some(n + 5), r.randrange(4), money(), r.choice(["x", "", None])) for _ in range(2 * n)]
    return {"clients": clients, "clicks": clicks + clicks[:5], "sales": sales, "sale_lines": lines}


def plain(tables: dict[str, list[tuple]], files: int, share: int) -> list[tuple]:
    clients, clicks, sales, lines = (tables[t] for t in erasure.AMOUNTS)
    owner = {s[0]: s[1] for s in sales}
    counts: dict = {c[1]: 0 for c in clients if c[1] is not None}
    master = {c[0]: c[1] for c in clients}
    for c in clicks:
        if c[2] is not None and master.get(c[2]) is not None:
            counts[master[c[2]]] += 1
    masters = {m for m in counts if crc(m) % share == 0} | ({min(counts, key=lambda m: (-counts[m], m))} if counts else set())
    owned = {c[0] for c in clients if c[1] in masters} - {None}
    sold = {s[0] for s in sales if s[1] in owned}
    hit = {"clients": lambda r: r[1] in masters, "clicks": lambda r: r[2] in owned, "sales": lambda r: r[1] in owned, "sale_lines": lambda r: r[0] in sold}
    client = {"clients": lambda r: r[0], "clicks": lambda r: r[2], "sales": lambda r: r[1], "sale_lines": lambda r: owner.get(r[0])}
    out = []
    for name, rows in tables.items():
        columns = [c.split(" ")[0].strip("`") for c in SCHEMAS[name].split(", ")]
        value = columns.index(erasure.AMOUNTS[name])
        order = sorted(rows, key=lambda r: (crc(client[name](r)), [(v is not None, 0 if v is None else v) for v in r]))
        size = 1 + len(rows) // files
        for at in range(0, len(rows), size):
            part = order[at : at + size]
            left = [r for r in part if not hit[name](r)]
            if left:
                cents = sum(0 if r[value] is None else math.floor(100 * r[value] + 0.5) for r in left)
                ids = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in left).encode()).hexdigest()
                out.append((name, at // size, len(left), len(part) - len(left), cents, len(left) < len(part), ids, ",".join(columns), left))
    return out


@pytest.mark.parametrize(("n", "files", "hot"), [(160, 20, None), (600, 350, 5), (300, 7, 5)])
def test_equals_plain_lists(spark, n, files, hot):
    tables = made(n, n, hot)
    frames = [spark.createDataFrame(rows, SCHEMAS[t]) for t, rows in tables.items()]
    folder = erasure.new_folder(spark)
    rows = erasure.erased(*frames, folder, erasure.Layout(files, 9)).collect()
    expected = plain(tables, files, 9)
    assert sorted(tuple(r)[:8] for r in rows) == sorted(x[:8] for x in expected)
    assert any(x[5] for x in expected)
    content = {(x[0], x[1]): x[8] for x in expected}
    for r in rows:
        table = pq.read_table(r.path)
        got = list(zip(*(c.to_pylist() for c in table.columns), strict=True))
        assert got == content[r.table_name, r.file_no]
        footer = pq.ParquetFile(r.path).metadata
        firsts = [x[0] for x in got if x[0] is not None]
        for stats in [footer.row_group(i).column(0).statistics for i in range(footer.num_row_groups)][:1]:
            assert not firsts or stats is None or not stats.has_min_max or (footer.num_row_groups > 1 or (stats.min, stats.max) == (min(firsts), max(firsts)))
    left = {str(p) for p in Path(folder.removeprefix("file://")).rglob("*.parquet")}
    assert left == {r.path for r in rows}
    untouched = [r for r in rows if not r.rewritten]
    assert all("-rewritten" not in r.path for r in untouched)


def test_empty_tables(spark):
    frames = [spark.createDataFrame([], s) for s in SCHEMAS.values()]
    assert erasure.erased(*frames, erasure.new_folder(spark)).collect() == []
    tables = made(3, 40)
    frames = [spark.createDataFrame(tables[t] if t == "clients" else [], s) for t, s in SCHEMAS.items()]
    rows = erasure.erased(*frames, erasure.new_folder(spark), erasure.Layout(5, 9)).collect()
    assert sorted(tuple(r)[:8] for r in rows) == sorted(x[:8] for x in plain({t: v if t == "clients" else [] for t, v in tables.items()}, 5, 9))


def test_survivors_over_batch_borders():
    batches = [pa.record_batch({"x": list(range(i, i + 4))}) for i in range(0, 12, 4)]
    gone = [(0, 0), (2, 5), (7, 7), (9, 11)]
    kept = [b.column(0).to_pylist() for part in erasure.survivors(batches, gone) for b in part]
    assert kept == [[1], [6], [8]]


def test_rewrite_can_run_again(tmp_path):
    pq.write_table(pa.table({"x": range(100)}), tmp_path / "a.parquet")
    (tmp_path / "s").mkdir()
    for _ in range(2):
        assert erasure.rewrite(f"file://{tmp_path}/a.parquet", f"file://{tmp_path}/b.parquet", f"file://{tmp_path}/s", [(0, 97)]) == 2
    assert pq.read_table(tmp_path / "b.parquet").column("x").to_pylist() == [98, 99]
    assert pq.ParquetFile(tmp_path / "b.parquet").metadata.row_group(0).column(0).statistics.min == 98
    assert not list((tmp_path / "s").iterdir())


def test_folder_is_shared(spark):
    assert erasure.new_folder(spark).startswith(store.checkpoint_dir(spark))
