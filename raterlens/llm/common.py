"""Helpers shared by the operators of this package."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterlens.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Bytes of a word: 0-9, a-z and every byte of a non-ASCII character; A-Z fold
# to a-z and all other ASCII becomes a space. Non-ASCII characters consist of
# bytes from 0x80 up, so this equals the character class
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))


def ascii_words(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z only (null: none)."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def held_out(id_col, mod: int, rest: int):
    """crc32 of the id as text modulo ``mod`` equals ``rest`` (null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(mod)
                      == F.lit(rest), F.lit(False))


def runs(batches, block: int | None = None):
    """Tables of consecutive rows of one key (the first column) from a sorted
    stream of record batches: whole runs, or blocks of at most ``block`` rows."""
    held = []  # record batches of the open run
    key = None

    def cut(parts):
        t = pa.Table.from_batches(parts)
        for lo in range(0, t.num_rows, block or t.num_rows):
            yield t.slice(lo, block or t.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for lo, hi in zip(edges, [*edges[1:], len(keys)]):
            if held and keys[lo] != key:
                yield from cut(held)
                held = []
            key = keys[lo]
            held.append(batch.slice(lo, hi - lo))
            rows = sum(b.num_rows for b in held)
            if block and rows >= 4 * block:  # long runs leave in whole blocks
                t = pa.Table.from_batches(held)
                whole = rows // block * block
                for at in range(0, whole, block):
                    yield t.slice(at, block)
                held = t.slice(whole).to_batches()
    if held:
        yield from cut(held)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph given as links (a, b).

    Returns (id, component), component being the smallest reachable id, for
    every id that occurs in a link. Each round hooks every node to its
    smallest neighbour, follows the parents twice and contracts the links, so
    long chains shrink geometrically; the tables of a round are written to
    the shared checkpoint folder. Only the emptiness of the rest reaches the
    driver.
    """
    edges = cut_lineage(
        links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .filter("a < b").distinct())
    label = None
    while True:
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")) \
            .select("n", F.least("n", "m").alias("p"))
        parent = cut_lineage(parent)
        for _ in range(2):
            up = parent.select(F.col("n").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("n", F.col("pp").alias("p"))
        parent = cut_lineage(parent)
        label = parent.select(F.col("n").alias("id"), F.col("p").alias("component")) \
            if label is None else cut_lineage(
                label.join(parent, F.col("component") == F.col("n"), "left")
                .select("id", F.coalesce("p", "component").alias("component")))
        edges = cut_lineage(
            edges.join(parent.select(F.col("n").alias("a"), F.col("p").alias("pa")), "a")
            .join(parent.select(F.col("n").alias("b"), F.col("p").alias("pb")), "b")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .filter("a < b").distinct())
        if edges.isEmpty():
            return label


HEAVY = 1024             # a key is heavy if it holds more than 1 / HEAVY of the rows
CELL_BITS = 32_768       # bits of one bitmap (fixed by Spark's bitmap functions)
CELLS = 2_048            # bitmaps of a filter: 8 MiB together, whatever the input


def heavy_keys(counts: DataFrame, total: int, heavy: int = HEAVY) -> DataFrame:
    """Of keys with their rows n: those with more than total / heavy rows (fewer
    than ``heavy`` of them) and over how many salts to deal their rows."""
    return (counts.filter(F.col("n") * F.lit(heavy) > F.lit(total))
            .withColumn("salts", F.ceil(F.col("n") * F.lit(heavy) / F.lit(max(1, total))).cast("bigint")).drop("n"))


def _place(key):
    return F.pmod(F.xxhash64(F.lit(7), key), F.lit(CELLS * CELL_BITS))


def cells_of(keys: DataFrame, key: str) -> DataFrame:
    """A filter over the values of a column: one bitmap a cell, at most CELLS of
    them. The tasks make bitmaps of their own values, united by cell."""
    place = keys.select(_place(key).alias("p"))
    return (place.groupBy((F.col("p") / CELL_BITS).cast("bigint").alias("__cell"))
            .agg(F.bitmap_construct_agg((F.col("p") % CELL_BITS).cast("bigint")).alias("__bitmap")))


def in_cells(rows: DataFrame, key: str, cells: DataFrame) -> DataFrame:
    """Rows whose key may be in the filter: all that are, and a share of the
    others that is the filled share of its bits. The cells are broadcast; their
    size is fixed."""
    p, columns = _place(key), rows.columns
    return (rows.withColumn("__cell", (p / CELL_BITS).cast("bigint")).withColumn("__bit", p % CELL_BITS)
            .join(F.broadcast(cells), "__cell")
            .filter(F.expr("bit_get(CAST(conv(hex(substring(__bitmap, CAST(__bit / 8 AS INT) + 1, 1)), 16, 10) AS INT), "
                           "CAST(__bit % 8 AS INT)) = 1"))
            .select(*columns))


def split_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` (not null, unique in ``right``) for a written table
    ``left`` in which some keys may hold a large share of the rows: the right
    rows of heavy keys, fewer than HEAVY, are broadcast; the rest shuffles."""
    heavy = heavy_keys(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), left.count()).drop("salts")
    heavy = F.broadcast(cut_lineage(heavy))
    few = F.broadcast(right.join(heavy, keys, "left_semi"))
    return left.join(few, keys).unionByName(left.join(heavy, keys, "left_anti").join(right, keys))
