from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from rowmend.sources import records
from rowmend.sources.csv import csv_scan


def walk(line, inside):
    """State after a line, read character by character."""
    state = "quoted" if inside else "begin"
    i = 0
    while i < len(line):
        c = line[i]
        if state == "begin":
            state = "quoted" if c == '"' else "begin" if c == "," else "plain"
        elif state == "plain":
            state = "begin" if c == "," else "plain"
        elif c == '"':
            if line[i + 1 : i + 2] == '"':
                i += 1
            else:
                state = "plain"
        i += 1
    return state == "quoted"


@pytest.mark.parametrize("seed", range(40))
def test_states_match_a_walk(seed):
    rng = random.Random(seed)
    for _ in range(300):
        line = "".join(rng.choice('a"",, \r') for _ in range(rng.randint(0, 14)))
        for inside in (False, True):
            assert records.open_after(line, inside) == walk(line, inside), (line, inside)


def field(rng):
    kind = rng.random()
    if kind < 0.15:
        return '"' + "".join(rng.choice(['x', '""', "\n", ",", "\r\n", " ", "é"]) for _ in range(rng.randint(1, 30))) + '"'
    if kind < 0.2:
        return f'{rng.randint(1, 9)}" pipe'
    return rng.choice(["", "plain", "12.5", "N/A", "two words", "-7"])


def write(path, seed, rows=400, end="\n", header="k,a,b,c", long=()):
    rng = random.Random(seed)
    text = [header]
    for i in range(rows):
        if i in long:
            text.append(f'{i},"{"long text" + chr(10)}{("line " + chr(10)) * 4000}",{field(rng)},x')
        else:
            text.append(f"{i},{field(rng)},{field(rng)},{field(rng)}")
    path.write_bytes((end.join(text) + rng.choice(["", end])).encode())


def plain_read(spark, path):
    """The same files, each whole in one task."""
    schema = "k string, a string, b string, c string"
    return spark.read.csv(str(path), header=True, schema=schema, multiLine=True, quote='"', escape='"')


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,end,long", [(1, "\n", ()), (2, "\r\n", ()), (3, "\n", (100, 101, 250)), (4, "\n", (0,)), (5, "\r\n", (399,))])
def test_ranges_give_the_rows_of_a_whole_read(spark, tmp_path, small_ranges, seed, end, long):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", seed, end=end, long=long)
    write(folder / "b.csv", seed + 100, rows=50, end=end)
    found = csv_scan(spark, str(folder), schema=plain_read(spark, folder).schema, tokens=[])
    assert rows(found) == rows(plain_read(spark, folder))
    assert found.select(F.spark_partition_id()).distinct().count() > 4


def test_one_file_with_broken_records_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    write(tmp_path / "a.csv", 7, rows=2000)
    text = records.lines(spark, str(tmp_path / "a.csv"))
    spans, broken = records.open_spans(text)
    assert len(broken) == 1 and spans
    cut = records.records(text, spans, [(f, False) for f in broken]).withColumn("task", F.spark_partition_id())
    per_task = [r["count"] for r in cut.groupBy("task").count().collect()]
    assert len(per_task) > 8 and max(per_task) < 500 and sum(per_task) == 2000


def test_plain_files_keep_the_reader_of_lines(spark, tmp_path, small_ranges):
    (tmp_path / "p.csv").write_text("k,a\n" + "\n".join(f'{i},"v, {i}"' for i in range(500)))
    found = csv_scan(spark, str(tmp_path / "p.csv"))
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    assert rows(found) == sorted([(i, f"v, {i}") for i in range(500)], key=repr)


@pytest.mark.parametrize("text,want", [
    ('a,b\n1,"x\ny"\n\n2,z\n', [(1, "x\ny"), (2, "z")]),
    ('\n\na,b\n1,"x\ny"', [(1, "x\ny")]),
    ('"a\n1",b\n1,"x\ny"\n', [(1, "x\ny")]),
    ('a,b\r\n1,"x\r\ny"\r\n2,"q""\n""r"\r\n', [(1, "x\ny"), (2, 'q"\n"r')]),
    ('a,b\r1,x\r2,y\r', [(1, "x"), (2, "y")]),
    ('a,b\n', []),
])
def test_line_ends_and_headers(spark, tmp_path, text, want):
    (tmp_path / "f.csv").write_bytes(text.encode())
    found = csv_scan(spark, str(tmp_path / "f.csv"))
    assert [tuple(r) for r in found.orderBy(found.columns[0]).collect()] == want


def test_same_rows_as_the_csv_module(spark, tmp_path, small_ranges):
    rng = random.Random(11)
    table = [[str(i), "".join(rng.choice('ab",\n ') for _ in range(rng.randint(1, 40))) + "z"] for i in range(600)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["k", "t"], *table])
    (tmp_path / "m.csv").write_text(out.getvalue())
    found = csv_scan(spark, str(tmp_path / "m.csv"), tokens=[])
    assert rows(found) == sorted([(int(k), t) for k, t in table], key=repr)
