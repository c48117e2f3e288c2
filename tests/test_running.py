"""Running totals, exact quantiles, text-safe CSV, nested JSON and the
checkpoint folder rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterlens import session
from raterlens.operators.running import quantiles, running_totals
from raterlens.sources import files


def test_running_totals_over_all_rows_and_by_group(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), int(g), int(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 9, 500)))]
    df = spark.createDataFrame(rows, "id long, g long, v long")
    got = {r["id"]: r["t"] for r in running_totals(df, [("v", False), ("id", True)], {"t": F.col("v")}).collect()}
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert got == dict(zip([r[0] for r in order], np.cumsum([r[2] for r in order]).tolist()))
    got = {r["id"]: r["n"] for r in running_totals(df, [("id", True)], {"n": F.lit(1)}, ["g"]).collect()}
    assert got == {r[0]: sum(x[1] == r[1] and x[0] <= r[0] for x in rows) for r in rows}


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g) if g else None, float(v)) for g, v in zip(rng.integers(0, 4, 700), np.round(rng.normal(size=700), 1))]
    df = spark.createDataFrame([*rows, (9, None), (8, 2.5)], "g long, v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["g"]: [r[k] for k in probs] for r in quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == {None, 1, 2, 3, 8}
    for g, q in got.items():
        values = [v for x, v in [*rows, (8, 2.5)] if x == g]
        assert np.allclose(q, np.quantile(values, list(probs.values())))
    one = quantiles(df, [], "v", {"m": 0.5}).collect()
    assert one[0]["m"] == pytest.approx(np.median([v for _, v in rows] + [2.5]))


def test_csv_keeps_line_breaks_quotes_and_backslashes(spark, tmp_path):
    rows = [("a\nb\\n", 1), ('say "x", y\r\n', 2), ("\\", 3), ("plain", None)]
    df = spark.createDataFrame(rows, "comment string, n int")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_json_lines_nest_several_ratings(spark, tmp_path):
    rows = [("c1", 1, "s", f"w{i}", i % 5) for i in range(40)] + [("c2", 2, None, "w1", 3)]
    df = spark.createDataFrame(rows, "comment string, comment_id long, source string, worker_id string, toxic_score int")
    path = str(tmp_path / "j")
    files.write_ratings_jsonl(df, path, per_document=10)
    assert 3 <= spark.read.text(path).count() <= 9
    assert sorted(map(tuple, files.read_ratings_jsonl(spark, path).collect()), key=str) == sorted(rows, key=str)


def test_no_scratch_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
