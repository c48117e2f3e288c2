"""File sources and sinks: CSV with header, JSON lines with nested ratings,
model-input export, matrix files by row position (A1, A3, A4, A7, A9)."""

from __future__ import annotations

import ast
import math

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATING_RECORD = T.StructType([
    T.StructField("worker_id", T.StringType()),
    T.StructField("toxic_score", T.IntegerType()),
])

RAW_DOCUMENT = T.StructType([
    T.StructField("comment", T.StringType()),
    T.StructField("comment_id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("ratings", T.ArrayType(RATING_RECORD)),
])


def _escape(c):
    """Backslashes and line breaks as two characters, so a record is one line."""
    for raw, coded in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(coded))
    return c


def _unescape(c):
    parts = F.split(c, r"\\\\")
    plain = F.transform(parts, lambda p: F.replace(
        F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(plain, "\\")


def _strings(schema: T.StructType) -> set[str]:
    return {f.name for f in schema if isinstance(f.dataType, T.StringType)}


_UNQUOTED = "\x01empty\x01"  # what the parser puts for an empty field without quotes
ESCAPED = "_ESCAPED"  # a file beside the data of write_csv; readers skip names with an underscore


def _marker(spark: SparkSession, path: str):
    """The marker's place and its file system (any that Spark reads)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path, ESCAPED)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, no index. Line breaks inside strings are escaped,
    so files split at line ends whatever their size; a marker file says so."""
    text = _strings(df.schema)
    (df.select(*[_escape(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])
     .write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False).csv(path))
    place, fs = _marker(df.sparkSession, path)
    fs.create(place).close()


def read_csv(spark: SparkSession, path: str, schema: T.StructType, one_line_records: bool = False) -> DataFrame:
    """A1: CSV with header and an explicit schema (no inference pass); a record
    that doesn't fit the schema fails the job.

    A folder of :func:`write_csv` is split at line ends, and its escapes are
    undone. Any other file is read as its writer meant it: quoted fields may
    hold line breaks, quotes are doubled, a backslash is a backslash. Such a
    file is one task, unless the caller knows that no record has a line break
    (``one_line_records``). An empty field is null, a quoted one empty."""
    place, fs = _marker(spark, path)
    ours = fs.exists(place)
    reader = spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "FAILFAST") \
        .option("nullValue", _UNQUOTED)
    df = reader.option("multiLine", not (ours or one_line_records)).csv(path)
    text = _strings(schema) if ours else ()
    return df.select(*[_unescape(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])


def write_ratings_jsonl(ratings: DataFrame, path: str, per_document: int = 50) -> None:
    """A3: JSON lines, a comment's ratings nested in one document or, for a
    popular comment, dealt by a hash of the rater over documents of about
    ``per_document`` ratings, so no record grows with the data."""
    key = ["comment", "comment_id", "source"]
    parts = ratings.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(per_document)).cast("bigint").alias("__parts"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in key]
    dealt = ratings.alias("r").join(parts.alias("p"), same).select(
        *[F.col(f"r.{c}") for c in key], "r.worker_id", "r.toxic_score",
        F.pmod(F.xxhash64("r.worker_id"), F.col("__parts")).alias("__part"))
    (dealt.groupBy(*key, "__part").agg(F.collect_list(F.struct("worker_id", "toxic_score")).alias("ratings"))
     .drop("__part").write.mode("overwrite").json(path))


def read_ratings_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A3: JSON lines, one document per comment with a nested ``ratings`` list;
    flattened to one row per rating with the parent fields repeated."""
    return explode_ratings(spark.read.schema(RAW_DOCUMENT).json(path))


def explode_ratings(docs: DataFrame) -> DataFrame:
    return docs.select("comment", "comment_id", "source", F.explode("ratings").alias("r")).select(
        "comment", "comment_id", "source", "r.worker_id", "r.toxic_score")


def parse_ratings_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """A3 on a string column of JSON documents (``from_json``)."""
    return explode_ratings(lines.select(F.from_json(column, RAW_DOCUMENT).alias("d")).select("d.*"))


def model_input(df: DataFrame, text: str = "comment", label: str = "toxic_score",
                annotator: str = "annotator_id", keep=()) -> DataFrame:
    """The columns a text classifier consumes, renamed; ``keep`` adds others."""
    return df.select(*keep, F.col(text).alias("text"), F.col(label).cast("int").alias("label"),
                     F.col(annotator).alias("annotator_ids"))


def export_model_input(df: DataFrame, path: str) -> None:
    """Model input as Parquet, one folder a split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


# --- matrix files (A4) --------------------------------------------------------

_MAGIC = b"\x93NUMPY"
_HEADER_BLOCK = 64      # headers written here are a multiple of it
MATRIX_ROWS = 250_000   # rows a file written here holds at most, in the memory of one task


def _files(spark: SparkSession, path: str) -> list[str]:
    """The file, or the data files of a folder in the order of their names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f.getPath().getName(), f.getPath().toString()) for f in fs.listStatus(place))
    return [p for name, p in found if not name.startswith(("_", "."))]


def _matrix_header(spark: SparkSession, path: str) -> tuple[int, np.dtype, int, int]:
    """Bytes of the header, element type, rows and columns of a matrix file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)

    def read(n):
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

    try:
        head = read(12)
        if head[:6] != _MAGIC:
            raise ValueError(f"{path} is no matrix file")
        at, size = (10, 2) if head[6] == 1 else (12, 4)
        length = at + int.from_bytes(head[at - size:at], "little")
        head += read(length - 12)
    finally:
        stream.close()
    spec = ast.literal_eval(head[at:length].decode("latin-1"))
    if spec["fortran_order"] or len(spec["shape"]) != 2:
        raise ValueError(f"{path}: only matrices in row order")
    return length, np.dtype(spec["descr"]), *spec["shape"]


def read_matrix(spark: SparkSession, path: str, values: str = "values") -> DataFrame:
    """A4: rows of a matrix file (or a folder of them, in the order of their
    names) as (position bigint, ``values`` array<double>).

    The header is decoded once on the driver. The data is read as records of a
    fixed length, so a file is split over tasks, and a row's position follows
    from the order of the records. Where the header isn't a whole number of
    rows, records are the largest parts that divide both, put together again
    by position."""
    out, first = [], 0
    for file in _files(spark, path):
        start, kind, rows, columns = _matrix_header(spark, file)
        width = columns * kind.itemsize
        if not rows or not columns:
            continue
        part = math.gcd(start, width)
        skip, parts = start // part, width // part
        stored = spark.sparkContext.binaryRecords(file, part).zipWithIndex().toDF("record binary, i bigint")
        stored = stored.filter((F.col("i") >= skip) & (F.col("i") < skip + rows * parts)).select(
            F.floor((F.col("i") - skip) / parts).alias("row"), ((F.col("i") - skip) % parts).alias("part"), "record")
        if parts > 1:
            stored = stored.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "record"))).alias("p")) \
                .select("row", F.aggregate("p.record", F.lit(b""), lambda a, r: F.concat(a, r)).alias("record"))

        def decode(batches, kind=kind):
            for b in batches:
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), kind).astype("f8")
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(list(x.reshape(b.num_rows, -1)) if b.num_rows else [], pa.list_(pa.float64()))],
                    names=["position", values])

        out.append(stored.select((F.col("row") + first).alias("position"), "record")
                   .mapInArrow(decode, f"position bigint, {values} array<double>"))
        first += rows
    if not out:
        return spark.createDataFrame([], f"position bigint, {values} array<double>")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def write_matrix(rows: DataFrame, path: str, position: str, values: str) -> None:
    """A4: an array column as a folder of matrix files in the order of
    ``position``, each at most about MATRIX_ROWS rows. Every file ends with a
    line separator of one row's length, which its header doesn't count."""
    columns = rows.select(F.max(F.size(values))).first()[0] or 0
    files = max(1, -(-rows.count() // MATRIX_ROWS))

    def encode(batches):
        held = [np.array(b.column(0).to_pylist(), "<f8").reshape(-1, columns) for b in batches if b.num_rows]
        if held:
            x = np.concatenate(held)
            spec = repr({"descr": "<f8", "fortran_order": False, "shape": x.shape})
            pad = -(len(spec) + 11) % _HEADER_BLOCK
            head = _MAGIC + b"\x01\x00" + (len(spec) + pad + 1).to_bytes(2, "little") + (spec + " " * pad + "\n").encode()
            yield pa.RecordBatch.from_arrays([pa.array([head + x.tobytes()], pa.binary())], names=["file"])

    ordered = rows.select(position, F.col(values).cast("array<double>").alias(values)) \
        .repartitionByRange(files, position).sortWithinPartitions(position).select(values)
    (ordered.mapInArrow(encode, "file binary").select(F.col("file").cast("string"))
     .write.mode("overwrite").option("lineSep", " " * max(1, 8 * columns)).text(path))
