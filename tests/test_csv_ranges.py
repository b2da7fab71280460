"""CSV with line breaks in cells, read by many tasks: equal to the one-task reader, whatever the splits."""

import os
import random

import pytest
from pyspark.sql import functions as F

from capforge.sources import csvrecords as C
from capforge.sources import files as IO


def write(folder, name, data: bytes):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data)


def sample(seed: int, n: int, end: str = "\n") -> str:
    rng = random.Random(seed)
    rows = ["id,note,other"]
    for i in range(n):
        cell = rng.choice(["plain", "", '"quoted, with comma"', '"two\nlines"', '"a ""quote"" and\n\nmore,\n"', "5\" pipe", '"' + "long\n" * rng.randrange(60) + '"',
                           '"""', '"x"y', '"carriage\r\nreturn"', "é\"è"])
        if cell == '"""':
            cell = '"ends with a quote"""'
        rows.append(f"{i},{cell},{rng.choice(['', 'z', '0.5'])}")
        if rng.random() < 0.05:
            rows.append("")
    return end.join(rows) + end


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_ranges_equal_one_task(spark, tmp_path, small_splits, seed, end):
    folder = str(tmp_path / "in")
    write(folder, "a.csv", sample(seed, 150, end).encode())
    write(folder, "b.csv", sample(seed + 10, 40, end).encode())
    write(folder, "c.csv", f"id,note,other{end}".encode())
    assert C.has_line_breaks(spark, folder) and C.lines(spark, folder).rdd.getNumPartitions() > 8
    got = IO.scan_csv(spark, folder, "id long, note string, other string")
    want = IO.scan_csv(spark, folder, "id long, note string, other string", multi_line=True)
    # the one-task reader turns the breaks of a file with \\r\\n into \\n inside cells too
    as_read = lambda df: df.withColumn("note", F.regexp_replace("note", "\r\n", "\n")) if end == "\r\n" else df
    assert rows_of(as_read(got)) == rows_of(as_read(want)) and got.count() == 190
    assert rows_of(got.select("other")) == rows_of(want.select("other"))


def test_cells_longer_than_a_range(spark, tmp_path, small_splits):
    folder = str(tmp_path / "in")
    long = "\n".join(f"line {i}, with a comma" for i in range(300))
    write(folder, "a.csv", f'id,note\n1,"{long}"\n2,short\n3,"{long}"\n'.encode())
    got = {r.id: r.note for r in IO.scan_csv(spark, folder).collect()}
    assert got == {1: long, 2: "short", 3: long}


def test_without_line_breaks_lines_are_records(spark, tmp_path, small_splits):
    folder = str(tmp_path / "in")
    write(folder, "a.csv", ("id,note\n" + "".join(f'{i},"a, ""b"" {i}"\n' for i in range(200))).encode())
    assert not C.has_line_breaks(spark, folder)
    df = IO.scan_csv(spark, folder)
    assert df.rdd.getNumPartitions() > 4 and df.count() == 200 and df.agg(F.max("note")).first()[0] == 'a, "b" 99'


@pytest.mark.parametrize("note", ["x", '"x\ny"'])
def test_too_many_cells_whatever_is_read(spark, tmp_path, note):
    folder = str(tmp_path / "in")
    write(folder, "a.csv", f"a,b\n1,{note}\n3,4,5\n".encode())
    df = IO.scan_csv(spark, folder, "a string, b string")
    for read in (lambda: df.collect(), lambda: df.select("b").collect(), lambda: df.count(), lambda: df.select("a").collect()):
        with pytest.raises(Exception, match="too many cells"):
            read()


def test_short_rows_and_header_only(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(folder, "a.csv", b'a,b,c\n1\n2,"x\ny"\n\n3,4,5\n')
    assert rows_of(IO.scan_csv(spark, folder)) == rows_of(IO.scan_csv(spark, folder, multi_line=True)) == [
        (1, None, None), (2, "x\ny", None), (3, "4", 5)]


@pytest.mark.parametrize("line,outside,inside", [
    ("a,b", False, True), ('a,"b', True, False), ('"a""', True, False), ('a"b', False, False), ('"a","b', True, True), ('x""y', False, True),
    ('"', True, False), ('""', False, True), ('"""', True, False), ('",', True, False), (',"', True, False), ('"a"b"c,"', True, True)])
def test_line_states(line, outside, inside):
    assert (C.ends_inside(line, False), C.ends_inside(line, True)) == (outside, inside)
