"""Splittable CSV against Python's csv module, over many small splits."""
import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.sources import contract, quoted_csv


def cells(rng):
    parts = ["x", "12", ",", '"', '""', "\n", "\r\n", "\n\n", " ", "é", '",', ',"', '\n"', "NA", "long " * 9]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))


def write(path, rows, **kwargs):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\n", **kwargs)
    writer.writerow(["id", "a", "b,c", "d"])
    writer.writerows(rows)
    path.write_bytes(out.getvalue().encode())
    return out.getvalue()


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_records_over_many_splits(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    rows = [[str(i), cells(rng), cells(rng), "z" if i % 7 else "one\n" * rng.randint(1, 300)] for i in range(150)]
    text = write(tmp_path / "f.csv", rows)
    got = quoted_csv.read_quoted_csv(spark, str(tmp_path / "f.csv"))
    assert got.columns[:4] == ["id", "a", "b,c", "d"] and got.select("_block").distinct().count() > 20
    ordered = got.orderBy("_file", "_block", "_pos").collect()
    want = [r for r in csv.reader(io.StringIO(text, newline=""))][1:]
    clean = lambda v: (v or "").replace("\r\n", "\n")
    assert [[clean(v) for v in r[:4]] for r in ordered] == [[clean(v) for v in r] for r in want]


def test_quotes_inside_plain_fields_open_nothing(spark, tmp_path, small_splits):
    lines = ["id,size,note"] + [f'{i},5" pipe,"a ""b""{chr(10) if i == 40 else " "}c" tail' for i in range(80)]
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    got = quoted_csv.read_quoted_csv(spark, str(tmp_path / "f.csv")).orderBy("_block", "_pos").collect()
    assert [r["id"] for r in got] == [str(i) for i in range(80)] and {r["size"] for r in got} == {'5" pipe'}


def test_plain_files_and_several_files(spark, tmp_path, small_splits):
    write(tmp_path / "a.csv", [[str(i), "x", 'say "hi"', ""] for i in range(60)])
    assert quoted_csv.read_quoted_csv(spark, str(tmp_path / "a.csv")).where("`b,c` = 'say \"hi\"'").count() == 60
    write(tmp_path / "b.csv", [[str(100 + i), "two\nlines", "", "NA"] for i in range(60)])
    both = contract.read_text_csv(spark, str(tmp_path))
    assert both.count() == 120 and both.where("d IS NULL").count() == 120
    ids = [r["id"] for r in both.orderBy("seq").collect()]
    assert ids == [str(i) for i in range(60)] + [str(100 + i) for i in range(60)]


def test_empty_and_unclosed(spark, tmp_path, monkeypatch):
    (tmp_path / "h.csv").write_text('id,"a\nb",c\n')
    got = quoted_csv.read_quoted_csv(spark, str(tmp_path / "h.csv"))
    assert got.columns[:3] == ["id", "a\nb", "c"] and got.count() == 0
    monkeypatch.setattr(quoted_csv, "MAX_RECORD_LINES", 50)
    (tmp_path / "u.csv").write_text('id,a\n1,"never closed\n' + "2,x\n" * 100)
    with pytest.raises(ValueError, match="u.csv"):
        quoted_csv.read_quoted_csv(spark, str(tmp_path / "u.csv"))


def test_line_ends(spark):
    cases = {'a,b': (0, 1), '"a': (1, 0), 'a"': (0, 0), '"a","b': (1, 1), 'x,"y",z': (0, 0), '""': (0, 1), '"""': (1, 0), 'a","b': (1, 1), "": (0, 1)}
    rows = spark.createDataFrame([(k,) for k in cases], "line string")
    outside, inside = quoted_csv.line_ends(F.col("line"))
    got = {r["line"]: (r["o"], r["i"]) for r in rows.select("line", outside.alias("o"), inside.alias("i")).collect()}
    assert got == cases
