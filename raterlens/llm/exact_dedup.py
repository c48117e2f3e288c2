"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every task hashes its rows once and cuts them into chunks. A chunk keeps,
   for each owner of a range of the fingerprint space, its sorted rows (id,
   digest) and the Golomb code of its sorted distinct fingerprints. The
   chunks are written to the shared folder, so the chunk ids stay fixed
   whatever is recomputed later.
2. Only the compressed lists travel to the owners. A fingerprint that many
   copies share is sent once a chunk, so a hot text adds one code word a
   chunk, and owners stay even.
3. Owners send a bitmap back for each list: set where the fingerprint occurs
   in another chunk or more than once in the chunk.
4. Only suspects are verified. Their ids set bits of a filter of fixed size, and a second scan lets a text into the exchange only if its bit is
   set (a wrong bit costs a row, never a result). The normalised texts
   themselves are the grouping key, with partial sums before the shuffle, so a
   group of copies of any size arrives as one row a task. Suspects of a hot
   text meet its one group row by broadcast of the few hot groups.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlens.llm.common import LOWER, UPPER, cells_of, in_cells, shuffle_partitions, split_join
from raterlens.session import cut_lineage

FINGERPRINT_BITS = 48
CHUNK_ROWS = 50_000


def golomb_encode(values: np.ndarray) -> bytes:
    """Golomb code (power-of-two divisor) of sorted distinct integers: the
    first as it is, the gaps' quotients in unary, then their remainders in k
    bits each; k follows from the mean gap."""
    n = len(values)
    if n == 0:
        return b""
    values = values.astype(np.uint64)
    gaps = np.diff(values, prepend=values[0])
    k = max(0, int(np.log2(max(1.0, 0.69 * float(values[-1] - values[0]) / n))))
    q = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(q.sum()) + n, np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = np.array([n, k, len(unary)], "<u4").tobytes() + values[:1].astype("<u8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_decode(code: bytes) -> np.ndarray:
    if not code:
        return np.zeros(0, np.uint64)
    n, k, bits = (int(x) for x in np.frombuffer(code[:12], "<u4"))
    cut = 20 + (bits + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code[20:cut], np.uint8), count=bits))
    q = np.diff(ends, prepend=-1) - 1
    gaps = q.astype(np.uint64) << np.uint64(k)
    if k:
        rest = np.unpackbits(np.frombuffer(code[cut:], np.uint8), count=n * k).reshape(n, k)
        gaps += (rest.astype(np.uint64) << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.frombuffer(code[12:20], "<u8")[0]


def _fingerprints(digests: np.ndarray, bits: int) -> np.ndarray:
    """Leading bits of the digests (n x 32 bytes), as integers."""
    return np.ascontiguousarray(digests[:, :8]).view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - bits)


def _owner_of(fp: np.ndarray, owners: int, bits: int) -> np.ndarray:
    """Owners hold equal ranges of the fingerprint's leading 32 bits."""
    return ((fp >> np.uint64(bits - 32)) * np.uint64(owners)) >> np.uint64(32)


_BLOCKS = pa.schema([("chunk", pa.string()), ("owner", pa.int64()), ("code", pa.binary()),
                     ("several", pa.binary()), ("ids", pa.list_(pa.int64())), ("digests", pa.binary())])


def _chunk_blocks(owners: int, bits: int):
    def blocks(ids: list, digests: list):
        chunk = uuid.uuid4().hex
        d = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
        fp = _fingerprints(d, bits)
        order = np.argsort(fp, kind="stable")
        fp, d = fp[order], d[order]
        own = _owner_of(fp, owners, bits)
        cuts = np.flatnonzero(np.diff(own, prepend=np.uint64(owners + 1)))
        out = []
        for lo, hi in zip(cuts, [*cuts[1:], len(fp)]):
            values, counts = np.unique(fp[lo:hi], return_counts=True)
            out.append({"chunk": chunk, "owner": int(own[lo]), "code": golomb_encode(values),
                        "several": np.packbits(counts > 1).tobytes(),
                        "ids": [ids[i] for i in order[lo:hi]], "digests": d[lo:hi].tobytes()})
        return pa.RecordBatch.from_pylist(out, schema=_BLOCKS)

    def run(batches):
        ids, digests = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            for text in batch.column(1):
                raw = text.as_buffer() if text.is_valid else None
                digests.append(hashlib.sha256(raw.to_pybytes().lower() if raw else b"").digest())
            if len(ids) >= CHUNK_ROWS:
                yield blocks(ids, digests)
                ids, digests = [], []
        if ids:
            yield blocks(ids, digests)

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """One owner: for each list a bitmap of the fingerprints held elsewhere."""
    lists = [golomb_decode(c) for c in pdf["code"]]
    sizes = np.array([len(x) for x in lists])
    values, where, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    twice = counts[where] > 1
    bitmaps, at = [], 0
    for n, several in zip(sizes, pdf["several"]):
        local = np.unpackbits(np.frombuffer(several, np.uint8), count=n).astype(bool)
        bitmaps.append(np.packbits(twice[at:at + n] | local).tobytes())
        at += n
    return pd.DataFrame({"chunk": pdf["chunk"], "owner": pdf["owner"], "bitmap": bitmaps})


_MARKED = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("suspect", pa.bool_())])


def _mark(bits: int):
    def run(batches):
        for batch in batches:
            for ids, digests, bitmap in zip(*(batch.column(c).to_pylist() for c in range(3))):
                d = np.frombuffer(digests, np.uint8).reshape(-1, 32)
                values, where = np.unique(_fingerprints(d, bits), return_inverse=True)
                bit = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(values)).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([x.tobytes().hex() for x in d], pa.string()),
                     pa.array(bit[where])], schema=_MARKED)

    return run


def exact_duplicates(docs: DataFrame, fingerprint_bits: int = FINGERPRINT_BITS) -> DataFrame:
    """Groups of texts equal after lower-casing A-Z only.

    ``docs`` needs doc_id (integer) and text; further columns are ignored.
    Returns a row for every input row: doc_id, keep_id (the largest doc_id of
    the group), group_size (rows of the group), kept (doc_id = keep_id) and
    text_sha256 (of the normalised text).

    Null text counts as empty; all empty texts are one group. A null doc_id
    never wins against a number; a group of nulls alone has a null keep_id and
    all its rows kept. Repeated rows count in group_size and share their fate
    (equal ids cannot be told apart). An empty table gives no rows. Two
    different texts with one SHA-256 would raise an error, not merge. A very
    long text costs its task a few times its size; it is shuffled only if
    its fingerprint isn't alone, or the filter of suspects errs.
    """
    spark = docs.sparkSession
    owners = shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = cut_lineage(rows.mapInArrow(
        _chunk_blocks(owners, fingerprint_bits),
        "chunk string, owner bigint, code binary, several binary, ids array<bigint>, digests binary"))
    bitmaps = blocks.select("chunk", "owner", "code", "several").groupBy("owner").applyInPandas(
        _answer, "chunk string, owner bigint, bitmap binary")
    marked = cut_lineage(
        blocks.select("chunk", "owner", "ids", "digests").join(bitmaps, ["chunk", "owner"])
        .select("ids", "digests", "bitmap")
        .mapInArrow(_mark(fingerprint_bits), "doc_id bigint, text_sha256 string, suspect boolean"))
    suspects = marked.filter("suspect").drop("suspect")
    norm = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    verified = (in_cells(rows, "doc_id", cells_of(suspects, "doc_id"))
                .groupBy(norm.alias("norm"))
                .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
                .groupBy(F.sha2("norm", 256).alias("text_sha256"))
                .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"),
                     F.count(F.lit(1)).alias("texts"))
                .select("text_sha256", "keep_id", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
                    F.raise_error(F.lit("two texts share a SHA-256")).cast("bigint")).alias("group_size")))
    alone = marked.filter(~F.col("suspect")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    grouped = split_join(suspects, cut_lineage(verified), ["text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256")
    return alone.union(grouped)
