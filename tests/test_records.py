"""Records with line breaks inside quotes, over several byte ranges."""

import csv
import io
import random

import pytest

from hustings.operators.ingest import RAW_COLUMNS
from hustings.sources import files
from hustings.sources.records import csv_records


def expected(text):
    rows = list(csv.reader(io.StringIO(text, newline="")))
    return [tuple(r) for r in rows if r]


@pytest.fixture
def small_ranges(spark):
    """Ranges of 64 bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(path, rows, end="\n"):
    with open(path, "w", encoding="utf-8", newline="") as sink:
        csv.writer(sink, lineterminator=end).writerows(rows)
    return path.read_text(encoding="utf-8") if end == "\n" else None


@pytest.mark.parametrize("seed", range(3))
def test_records_cross_ranges(spark, tmp_path, small_ranges, seed):
    pick = random.Random(seed)
    cell = lambda: "".join(pick.choice(["a", "é", "\n", '"', ",", " ", "\n\n", "xyz", "中"]) for _ in range(pick.choice([0, 1, 3, 9, 150])))
    rows = [[str(i), cell(), cell()] for i in range(120)]
    write(tmp_path / "votes.csv", rows)
    found = csv_records(spark, str(tmp_path / "votes.csv"))
    assert found.rdd.getNumPartitions() > 8
    got = [r["record"] for r in found.orderBy("row_no").collect()]
    assert [tuple(next(csv.reader(io.StringIO(r, newline="")))) for r in got] == [tuple(r) for r in rows]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_the_scan_gives_the_rows_of_one_task(spark, tmp_path, small_ranges, end):
    pick = random.Random(9)
    n = len(RAW_COLUMNS)
    parts = ["", "x", "ä", 'a "b"', "one\ntwo", "long " * 30, ",", "\n\n\n", " padded "]
    rows = [[f"{i}-{k}" if k == 0 else pick.choice(parts) for k in range(n)] for i in range(60)]
    for name in ("a", "b"):
        write(tmp_path / f"{name}.csv", [RAW_COLUMNS, *rows, [f"last {name}"] + ["z"] * (n - 1)], end)
    found = files.scan_votes(spark, str(tmp_path))
    whole = (
        spark.read.schema(files.RAW_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path)).fillna("")
    )
    ours = [tuple(r)[:n] for r in found.orderBy("row_no").collect()]
    assert sorted(ours) == sorted(tuple(r) for r in whole.collect()) and len(ours) == 122
    assert ours[:61] == [tuple(r) for r in rows] + [("last a", *["z"] * (n - 1))]


def test_open_quotes_and_empty_files(spark, tmp_path):
    (tmp_path / "open.csv").write_text('h\n"a\nb\n\nc')
    assert [r["record"] for r in csv_records(spark, str(tmp_path / "open.csv")).orderBy("row_no").collect()] == ["h", '"a\nb\n\nc']
    (tmp_path / "none.csv").write_text("")
    assert csv_records(spark, str(tmp_path / "none.csv")).collect() == []
