"""CSV files in parts: rows as Spark's own reader gives them from whole files, however small the parts."""

from __future__ import annotations

import random

import pytest
from lodestream.sources import csv_files, split_csv

CELLS = ["a", "", "x y", '"q"', '"a,b"', '"line\nbreak"', '"two\n\nbreaks,\n"', '"say ""hi"""', '""""', '"\n"', '""', "mid\"quote", '"end"x', '"a"" \n ,"" b"', " lead", '"\n""\n"', "é", "5'6\"", '"tail" ']


def as_read_whole(spark, path, names):
    rows = spark.read.csv(path, schema=", ".join(f"`{n}` string" for n in names), header=True, multiLine=True, escape='"', quote='"', enforceSchema=True)
    return [tuple(r) for r in rows.collect() if any((c or "").strip(" ") for c in r)]


@pytest.fixture
def parts_of(spark):
    keys = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def small(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield small
    for k, v in keys.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("seed", "size", "end"), [(1, 64, "\n"), (2, 300, "\n"), (3, 128, "\r\n")])
def test_parts_give_the_rows_of_whole_files(spark, tmp_path, parts_of, seed, size, end):
    rng = random.Random(seed)
    for n in range(2):
        lines = ["Day,Campaign,Spend"] + [",".join(rng.choice(CELLS) for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(150)]
        (tmp_path / f"{n}.csv").write_text(end.join(lines).replace("\r\n" if end == "\n" else "\0", end) + (end if n else ""), newline="")
    path = str(tmp_path)
    want = as_read_whole(spark, path, ["Day", "Campaign", "Spend"])
    parts_of(size)
    if size < 1000:
        assert split_csv.records(spark, path).rdd.getNumPartitions() > 4
    found = csv_files.read(spark, path)
    assert found.columns == ["Day", "Campaign", "Spend", "row_seq"]
    got = [tuple(r)[:3] for r in sorted(found.collect(), key=lambda r: r.row_seq)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_one_record_over_many_parts_and_headers_with_breaks(spark, tmp_path, parts_of):
    long = "\n".join(f'row {i}, ""x""' for i in range(400))
    (tmp_path / "a.csv").write_text(f'"Top\nquery",Page\none,"{long}"\ntwo,"b"\n"un\nclosed,x')
    parts_of(100)
    rows = csv_files.read(spark, str(tmp_path)).orderBy("row_seq").collect()
    assert [r[0] for r in rows] == ["one", "two", "un\nclosed,x"]
    assert rows[0]["Page"] == long.replace('""', '"')


def test_order_and_empty_files(spark, tmp_path, parts_of):
    (tmp_path / "a.csv").write_text("h,i\n" + "".join(f'{i},"c\n{i}"\n' for i in range(500)))
    parts_of(200)
    assert [r.h for r in csv_files.read(spark, str(tmp_path / "a.csv")).orderBy("row_seq").collect()] == [str(i) for i in range(500)]
    (tmp_path / "b.csv").write_text("h,i\n")
    assert csv_files.read(spark, str(tmp_path / "b.csv")).count() == 0
    (tmp_path / "c.csv").write_text("")
    assert split_csv.records(spark, str(tmp_path / "c.csv")).count() == 0


STATES = [('a,"b', True, False), ('a"b', False, False), ('"a""', True, False), ('""', False, True), ("x", False, True), ('",', True, False), ('","', False, True), ('"a"b,"c', True, True), ('",""', True, False), ("a,b", False, True)]


@pytest.mark.parametrize(("line", "out", "inside"), STATES)
def test_states(line, out, inside):
    assert split_csv.inside_after(line, False) is out
    assert split_csv.inside_after(line, True) is inside
