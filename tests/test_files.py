"""CSV files of other writers and matrix files by row position."""

import csv

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterlens.operators import scoring as sc
from raterlens.sources import files

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.IntegerType())])
ROWS = [("x\ny", 1), ("C:\\new\\road", 2), ('say "hi", twice', 3), ("a\r\nb", 4), (None, None), ("", 6),
        ("\\n is no line break", 7), ("ünï 日本", 8), ('"', 9), ("\\", 10)]


def test_csv_of_pandas(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    pd.DataFrame({"a": [r[0] for r in ROWS], "n": pd.array([r[1] for r in ROWS], "Int64")}).to_csv(
        path, index=False, quoting=csv.QUOTE_MINIMAL)
    got = {tuple(r) for r in files.read_csv(spark, path, SCHEMA).collect()}
    want = {(a or None, n) if a is None else (a, n) for a, n in ROWS}
    # the writer makes no difference between missing and empty
    assert {(a or None, n) for a, n in got} == {(a or None, n) for a, n in want}


def test_own_csv_round_trip_and_plain_files_of_one_line_records(spark, tmp_path):
    path = str(tmp_path / "own")
    files.write_csv(spark.createDataFrame(ROWS, SCHEMA), path)
    got = sorted(map(tuple, files.read_csv(spark, path, SCHEMA).collect()), key=repr)
    assert got == sorted(ROWS, key=repr)
    lines = tmp_path / "lines.csv"
    lines.write_text("a,n\nC:\\new,1\nplain,2\n")
    for flag in (False, True):
        got = {tuple(r) for r in files.read_csv(spark, str(lines), SCHEMA, one_line_records=flag).collect()}
        assert got == {("C:\\new", 1), ("plain", 2)}


def test_records_that_do_not_parse_fail(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("a,n\nx,1\ny,not a number\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(bad), SCHEMA).collect()


@pytest.mark.parametrize("kind,columns", [("<f4", 2), ("<f8", 3), ("<f4", 3), (">f8", 5), ("<i4", 1)])
def test_matrix_of_numpy(spark, tmp_path, kind, columns):
    x = np.arange(1001 * columns).reshape(-1, columns).astype(kind)
    path = str(tmp_path / "m.npy")
    np.save(path, x)
    got = files.read_matrix(spark, path).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1001))
    assert np.array_equal(np.array([r["values"] for r in got]), x.astype("f8"))


def test_matrix_written_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MATRIX_ROWS", 30)
    d = spark.range(100).select(F.col("id").alias("p"), F.array(F.col("id") * 1.0, F.lit(-0.5), F.lit(None).cast("double")).alias("v"))
    path = str(tmp_path / "parts")
    files.write_matrix(d.repartition(7), path, "p", "v")
    got = files.read_matrix(spark, path, "v").orderBy("position").collect()
    assert [(r.position, r.v[0], r.v[1]) for r in got] == [(i, float(i), -0.5) for i in range(100)]
    assert all(np.isnan(r.v[2]) for r in got)
    rows = spark.createDataFrame([(f"{i:03d}",) for i in range(100)], "k string")
    joined = sc.positional_join(rows, files.read_matrix(spark, path, "v"), ["k"]).collect()
    assert {(r.k, r.v[0]) for r in joined} == {(f"{i:03d}", float(i)) for i in range(100)}
    with pytest.raises(Exception, match="differ in length"):
        sc.positional_join(rows.limit(99), files.read_matrix(spark, path, "v"), ["k"]).collect()


def test_empty_and_wrong_matrix(spark, tmp_path):
    np.save(str(tmp_path / "e.npy"), np.zeros((0, 4)))
    assert files.read_matrix(spark, str(tmp_path / "e.npy")).collect() == []
    (tmp_path / "w.npy").write_bytes(b"no matrix" * 20)
    with pytest.raises(ValueError, match="no matrix"):
        files.read_matrix(spark, str(tmp_path / "w.npy"))
