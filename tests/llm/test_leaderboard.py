"""Leaderboards: the ladder against sorting, and the change feed against a replay in plain Python."""

from __future__ import annotations

import datetime
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from lodestream.llm import leaderboard

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, day string, batch string, h string"


@pytest.mark.parametrize("seed", range(4))
def test_ladder(seed):
    rng = np.random.default_rng(seed)
    items, cents = rng.permutation(400), np.zeros(400)
    ladder, sums = leaderboard.Ladder(items, cents, 10, 12), np.zeros(400)
    for _ in range(60):
        at = rng.choice(400, rng.integers(1, 60), replace=False)
        delta = rng.integers(-6, 6, len(at)).astype(float)
        sums[at] += delta
        ladder.add(at, delta)
        want = sorted((-c, i) for c, i in zip(sums, items, strict=True) if c > 0)[:10]
        assert list(ladder.best().items()) == [(i, -c) for c, i in want]


def brute(lines, vendors, items, places=10):
    dated, out = [], []
    for line in lines:
        h = zlib.crc32(",".join("" if line[k] is None else str(line[k]) for k in ("sale_id", "item_id", "vendor_id", "line_no")).encode())
        s = (line["shipped_at"].date() - datetime.date(1970, 1, 1)).days if line["shipped_at"] else 19723 + h % 150
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        dated.append((a, s, max(1, min(10, 1 + (a - 19723) * 10 // 180)), line))
    largest = {}
    for _, s, b, _ in dated:
        largest[b] = max(s, largest.get(b, s))
    revenue, boards = defaultdict(lambda: defaultdict(int)), defaultdict(dict)
    for day in sorted({a for a, *_ in dated}):
        touched = set()
        for _, s, b, line in (d for d in dated if d[0] == day):
            floor = max((v for k, v in largest.items() if k < b), default=None)
            nation = vendors.get(line["vendor_id"])
            if (floor is not None and s + 3 < floor) or nation is None or line["item_id"] not in items or line["item_id"] is None:
                continue
            price = items[line["item_id"]]
            cents = math.floor(100 * line["amount"] + 0.5) if line["amount"] is not None else line["quantity"] * math.floor(100 * price + 0.5) if line["quantity"] is not None and price is not None else 0
            revenue[nation][line["item_id"]] += -cents if line["flag"] == "returned" else cents
            touched.add((nation, b))
        for nation, b in touched:
            now = {i: r for r, (_, i) in enumerate(sorted((-c, i) for i, c in revenue[nation].items() if c > 0)[:places], 1)}
            for i in now.keys() | boards[nation].keys():
                was, rank = boards[nation].get(i), now.get(i)
                if was != rank:
                    out.append((nation, day, i, b, "enter" if was is None else "exit" if rank is None else "move", was, rank, revenue[nation][i]))
            boards[nation] = now
    return sorted(out, key=str)


def test_feed_against_a_replay(spark):
    rng = np.random.default_rng(9)
    start, lines = datetime.datetime(2024, 1, 1), []
    for n in range(2500):
        none = lambda x, p=0.03: None if rng.random() < p else x  # noqa: E731, B023
        item = int(rng.integers(0, 60)) if rng.random() < 0.7 else 7
        lines.append({"sale_id": none(n // 3), "line_no": none(n % 3), "item_id": none(item), "vendor_id": none(int(rng.integers(0, 9))), "quantity": none(int(rng.integers(1, 9))), "amount": none(float(rng.integers(1, 40)) / 4, 0.2),
                      "discount": None, "flag": none(["kept", "returned", "returned", "swapped"][rng.integers(0, 4)]), "shipped_at": none(start + datetime.timedelta(days=int(rng.integers(0, 150)), hours=int(rng.integers(0, 24))))})
    lines += lines[:200]
    vendors, items = {0: 1, 1: 1, 2: 1, 3: 2, 4: 3, 5: None, 6: 1, 7: 2}, {i: None if i == 3 else i * 0.37 + 0.005 for i in range(55)}
    df = spark.createDataFrame([(*x.values(), "d", "b", "h") for x in lines], LINES)
    found = leaderboard.feed(df, spark.createDataFrame(list(vendors.items()), "vendor_id long, nation_id int"), spark.createDataFrame(list(items.items()), "item_id long, price double"), buckets=3)
    assert sorted(map(tuple, found.collect()), key=str) == brute(lines, vendors, items)


def test_empty(spark):
    found = leaderboard.feed(spark.createDataFrame([], LINES), spark.createDataFrame([], "vendor_id long, nation_id int"), spark.createDataFrame([], "item_id long, price double"))
    assert found.count() == 0 and [f.name for f in found.schema] == ["nation_id", "arrival_day", "item_id", "batch", "change", "old_rank", "new_rank", "revenue"]


def test_one_store_for_each_part(spark, tmp_path, monkeypatch):
    """A store costs memory at every start, so a start opens one for each part of the keys: no second state after the first."""
    monkeypatch.setattr(leaderboard, "shared_folder", lambda *_: str(tmp_path))
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    lines = spark.createDataFrame([(n, 0, n % 5, 0, 1, 1.0 + n, None, "kept", day(n), "d", "b", "h") for n in range(0, 90, 3)], LINES)
    found = leaderboard.feed(lines, spark.createDataFrame([(0, 1)], "vendor_id long, nation_id int"), spark.createDataFrame([(n, 1.0) for n in range(5)], "item_id long, price double"), partitions=3)
    assert {r.nation_id for r in found.collect()} == {1}
    assert len([x for x in (tmp_path / "checkpoint/state").glob("*/*") if x.name.isdigit()]) == 3


def test_stores_leave_no_native_memory(spark, tmp_path, monkeypatch):
    """Each start opens a store for each part; a store of RocksDB leaves native memory with the executor for good, so the state is kept in files of changes that the heap alone reads. Revenues pass from start to start."""
    monkeypatch.setattr(leaderboard, "shared_folder", lambda *_: str(tmp_path))
    opened = []
    monkeypatch.setattr(leaderboard, "candidates", lambda *a, f=leaderboard.candidates: (opened.append(spark.conf.get("spark.sql.streaming.maxBatchesToRetainInMemory")), f(*a))[1])
    before = spark.conf.get("spark.sql.streaming.maxBatchesToRetainInMemory")
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    lines = [dict(zip(("sale_id", "line_no", "item_id", "vendor_id", "quantity", "amount", "discount", "flag", "shipped_at"), (n, 0, n % 7, 0, 1, 1.0 + n % 11, None, "kept", day(n)), strict=True)) for n in range(150)]
    df = spark.createDataFrame([(*x.values(), "d", "b", "h") for x in lines], LINES)
    found = leaderboard.feed(df, spark.createDataFrame([(0, 1)], "vendor_id long, nation_id int"), spark.createDataFrame([(n, 1.0) for n in range(7)], "item_id long, price double"), partitions=2)
    assert sorted(map(tuple, found.collect()), key=str) == brute(lines, {0: 1}, dict.fromkeys(range(7), 1.0))
    assert len(opened) == 10 and set(opened) == {"0"} and spark.conf.get("spark.sql.streaming.maxBatchesToRetainInMemory") == before
    kept = [x for x in (tmp_path / "checkpoint/state").rglob("*") if x.is_file() and x.suffix != ".crc" and x.parent.name.isdigit()]
    assert len(kept) == 20 and {x.suffix for x in kept} == {".delta"}


def test_board_changes_in_any_order():
    """Days count, not the order in which the buckets' rows are read."""
    rows = [(7, 1, 1, 10, 5.0, True), (7, 1, 1, 11, 5.0, True), (7, 2, 1, 12, 9.0, True), (7, 3, 2, 10, 0.0, False), (7, 3, 2, 12, 4.0, True), (7, 4, 2, 10, 6.0, True)]
    want = [(1, 10, "enter", None, 1, 5), (1, 11, "enter", None, 2, 5), (2, 10, "move", 1, 2, 5), (2, 11, "exit", 2, None, 5), (2, 12, "enter", None, 1, 9), (3, 10, "exit", 2, None, 0), (3, 11, "enter", None, 1, 5), (3, 12, "move", 1, 2, 4), (4, 10, "enter", None, 1, 6), (4, 11, "move", 1, 2, 5), (4, 12, "exit", 2, None, 4)]
    for seed in range(3):
        mixed = random.Random(seed).sample(rows, len(rows))
        found = leaderboard.board_changes(pd.DataFrame(mixed, columns=["nation_id", "arrival_day", "batch", "item_id", "cents", "listed"]), 2)
        got = [(d, i, c, None if pd.isna(o) else int(o), None if pd.isna(n) else int(n), r) for _, d, i, _, c, o, n, r in found.itertuples(index=False)]
        assert sorted(got, key=str) == sorted(want, key=str)
