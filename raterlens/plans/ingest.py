"""Queries: sources and sinks."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterlens.plans.base import query
from raterlens.plans.oracle_views import with_views
from raterlens.session import ensure_checkpoint_dir
from raterlens.sources import files
from raterlens.sources import fixtures as fx

RAW_SCHEMA = T.StructType([
    T.StructField("comment", T.StringType()),
    T.StructField("comment_id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("worker_id", T.StringType()),
    T.StructField("toxic_score", T.IntegerType()),
    T.StructField("text_id", T.LongType()),
    T.StructField("annotator_id", T.LongType()),
])


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("scan_csv_roundtrip", with_views("ratings_raw") + """select comment, comment_id::bigint comment_id, source,
  worker_id, toxic_score::bigint toxic_score, text_id::bigint text_id, annotator_id::bigint annotator_id
  from ratings_raw""")
def scan_csv_roundtrip(spark, sf):
    """A7 then A1: write the raw ratings as CSV into the shared scratch folder
    and read them back with an explicit schema."""
    path = _scratch(spark, "csv-roundtrip")
    files.write_csv(fx.ratings_raw(spark, sf), path)
    return files.read_csv(spark, path, RAW_SCHEMA)


# Characters that CSV writers treat differently, put into the source column by rule.
_AWKWARD = 'q"uo""te, C:\\new\\road\nline\r\nbreak'
_AWKWARD_SQL = "'q\"uo\"\"te, C:\\new\\road' || chr(10) || 'line' || chr(13) || chr(10) || 'break'"


def _written_elsewhere(batches):
    """Rows as another library writes them to a CSV file, a text for each batch."""
    first = True
    for pdf in batches:
        for c in ("comment_id", "toxic_score"):
            pdf[c] = pdf[c].astype("Int64")
        text = pdf.to_csv(index=False, header=first, lineterminator="\n")
        first = False
        yield pd.DataFrame({"value": [text[:-1]]})


@query("scan_csv_foreign", with_views("ratings_raw") + f"""select comment, comment_id::bigint comment_id,
  case when comment_id % 3 = 0 then {_AWKWARD_SQL} || comment_id else source end source, worker_id,
  toxic_score::bigint toxic_score from ratings_raw""")
def scan_csv_foreign(spark, sf):
    """A1: CSV files written by another library, with quotes, line breaks and
    backslashes in their fields, read with an explicit schema."""
    path = _scratch(spark, "csv-foreign")
    raw = fx.ratings_raw(spark, sf).select(
        "comment", "comment_id", F.when(F.col("comment_id") % 3 == 0, F.concat(F.lit(_AWKWARD), "comment_id"))
        .otherwise(F.col("source")).alias("source"), "worker_id", "toxic_score")
    raw.mapInPandas(_written_elsewhere, "value string").write.text(path)
    schema = T.StructType([f for f in RAW_SCHEMA if f.name in raw.columns])
    return files.read_csv(spark, path, schema)


@query("explode_ratings_json", with_views("ratings_raw") + """select comment, comment_id::bigint comment_id,
  source, worker_id, toxic_score::bigint toxic_score from ratings_raw""")
def explode_ratings_json(spark, sf):
    """A3: ratings written as JSON lines, several to a document, read back as
    files and exploded to one row per rating."""
    path = _scratch(spark, "ratings-jsonl")
    files.write_ratings_jsonl(fx.ratings_raw(spark, sf), path)
    return files.read_ratings_jsonl(spark, path)


@query("model_input_export", with_views("split_ratings") + """select split, comment as text, y::bigint label,
  annotator_id::bigint annotator_ids from split_ratings""")
def model_input_export(spark, sf):
    """Model input (text, label, annotator_ids) of both splits, through
    its sink."""
    r = fx.split_ratings(spark, sf)
    path = _scratch(spark, "model-input")
    files.export_model_input(files.model_input(r, label="y", keep=["split"]), path)
    return spark.read.parquet(path).select("split", "text", "label", "annotator_ids")
