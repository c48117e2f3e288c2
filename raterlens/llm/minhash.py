"""Near duplicates by BagMinHash signatures.

A text is the multiset of its runs of five words. Weighted Jaccard similarity
(sum of the smaller over sum of the larger counts) is estimated by signatures
made from Poisson processes: an element of weight w owns a process of points
(time, level, slot) over the discretised weights 1, 2, 3, ...; the points of
levels up to w take part, and each slot keeps its earliest one. Two multisets
share a slot's point with a probability equal to their similarity. The levels
form a hierarchy of intervals (0,1], (1,2], (2,4], (4,8], ... with one process
each, at the interval's rate, whose points draw a level inside it; so a weight
of thousands takes a dozen processes. Points come in ascending time and stop
at a bound by which nearly all slots are filled (it doubles where some are
not), so a signature costs about a constant number of points, not one for each
element and slot.

Texts of equal words form one class before anything is compared, so copies
never meet in a bucket. Bands of the signatures make buckets; each member is
compared with the bucket's first one by the exact overlap of the multisets of
words, and components are formed. Where a bucket still holds several
components, the texts that such buckets join are compared with each other in
blocks: the exact overlaps of two blocks are one matrix product, and only the
components of its links leave it, never its pairs.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlens.llm.common import ascii_words, cells_of, components, in_cells, runs, shuffle_partitions, split_join
from raterlens.session import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5     # a pair at 0.8 shares no band with probability 5e-5
STEP_SHINGLES = 150_000
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 100_000  # of a block of compared texts
COLUMNS = 8192          # shingles of one matrix product
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _times_gold(k: int) -> np.uint64:
    return np.uint64(k * int(_GOLD) & 0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of all runs of five words; of all words, if fewer."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1) if len(h) else 0
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = _mix(out * _GOLD + h[k:k + n])
    return out


def shingle_counts(words: list[bytes]) -> Counter:
    """The multiset itself, for verification."""
    if len(words) < SHINGLE:
        return Counter([tuple(words)]) if words else Counter()
    return Counter(zip(*(words[k:] for k in range(SHINGLE))))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets (0 if one is empty)."""
    if len(a) > len(b):
        a, b = b, a
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    total = a.total() + b.total() - both
    return both / total if total else 0.0


def bag_signatures(owner: np.ndarray, element: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n x m, the bits of the earliest times) of n bags given as
    (owner, element hash, count) with distinct elements for each owner."""
    sig = np.full(n * m, np.inf)
    weight = np.bincount(owner, weights=count, minlength=n)
    depth = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)  # the last interval reached
    who = np.repeat(np.arange(len(owner)), depth + 1)
    k = np.arange(len(who)) - np.repeat(np.cumsum(depth + 1) - depth - 1, depth + 1)
    low = np.where(k == 0, 0, np.left_shift(1, np.maximum(k - 1, 0)))
    rate = np.maximum(low, 1)  # levels in the interval
    seed = _mix(element[who] + k.astype(np.uint64) * _GOLD)
    bag, top = owner[who], count[who]
    bound = np.divide(np.log(m) + 4, weight, out=np.zeros(n), where=weight > 0)
    todo = np.ones(n, bool)
    todo[weight == 0] = False
    while todo.any():
        at = np.flatnonzero(todo[bag])
        t = np.zeros(len(at))
        step = 0
        while len(at):
            r = _mix(seed[at] + _times_gold(3 * step + 1))
            t = t - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / (m * rate[at])
            live = t <= bound[bag[at]]
            at, t = at[live], t[live]
            s = seed[at] + _times_gold(3 * step + 2)
            slot = (_mix(s) % np.uint64(m)).astype(np.int64)
            level = low[at] + 1 + (_mix(s + _GOLD) % rate[at].astype(np.uint64)).astype(np.int64)
            inside = level <= top[at]
            np.minimum.at(sig, bag[at[inside]] * m + slot[inside], t[inside])
            step += 1
        todo &= np.isinf(sig.reshape(n, m)).any(1)
        bound[todo] *= 2
    return sig.view(np.uint64).reshape(n, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Keys (n x bands) of the signatures' bands; the band is part of the key."""
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (len(sig), 1))
    for k in range(rows):
        out = _mix(out * _GOLD + sig[:, k:bands * rows:rows])
    return out.view(np.int64)


_KEYS = pa.schema([("id", pa.int64()), ("words", pa.binary()), ("keys", pa.list_(pa.int64()))])


def _signed(ids, texts):
    """Digest of each text's words (null: no words) and the keys of its bands."""
    found = [ascii_words(t) for t in texts]
    hashes = [shingle_hashes(w) for w in found]
    owner = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])
    flat = np.concatenate(hashes)
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    new = np.flatnonzero((np.diff(flat, prepend=flat[:1] + np.uint64(1)) != 0) | (np.diff(owner, prepend=-1) != 0))
    count = np.diff(new, append=len(flat))
    sig = bag_signatures(owner[new], flat[new], count, len(texts), BANDS * ROWS)
    keys = band_keys(sig)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()),
         pa.array([hashlib.sha256(b" ".join(w)).digest() if w else None for w in found], pa.binary()),
         pa.array([k if w else None for k, w in zip(keys, found)], pa.list_(pa.int64()))], schema=_KEYS)


def _signatures(batches):
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py()
            ids.append(i)
            texts.append(t)
            size += len(t or "") // 6
            if size >= STEP_SHINGLES:
                yield _signed(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield _signed(ids, texts)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])


def _verify(threshold: float):
    def run(batches):
        last, bag = None, None
        for batch in batches:
            out = {"a": [], "b": [], "similarity": []}
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, bag = a, shingle_counts(ascii_words(ta.as_py()))
                s = similarity(bag, shingle_counts(ascii_words(tb.as_py())))
                if s >= threshold:
                    out["a"].append(a)
                    out["b"].append(b)
                    out["similarity"].append(s)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _LINKS], schema=_LINKS)

    return run


def _links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Verified pairs; a pair sorted by its first member keeps that member's
    multiset at hand."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a") \
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b") \
        .sortWithinPartitions("a").select("a", "b", "ta", "tb")
    return both.mapInArrow(_verify(threshold), "a bigint, b bigint, similarity double")


def _block_links(threshold: float):
    """Links inside one block or between two, for texts of different
    components. Columns: key, id, side (0, 1, or 2 where both blocks are one),
    component, text. The links of a pair of blocks form small components of
    their own; each member but the smallest gives one row (smallest, member),
    so a dense pair of blocks costs no more rows than it has members."""

    def run(batches):
        for t in runs(batches):
            ids, side, comp = (t.column(k).to_numpy() for k in (1, 2, 3))
            n = len(ids)
            hashes = [shingle_hashes(ascii_words(x)) for x in t.column(4).to_pylist()]
            size = np.array([len(h) for h in hashes])
            owner = np.repeat(np.arange(n), size)
            flat = np.concatenate(hashes)
            order = np.lexsort((flat, owner))
            flat, owner = flat[order], owner[order]
            same = (np.diff(flat, prepend=flat[:1] + np.uint64(1)) == 0) & (np.diff(owner, prepend=-1) == 0)
            start = np.flatnonzero(~same)
            nth = np.arange(len(flat)) - np.repeat(start, np.diff(start, append=len(flat)))
            # the multiset as a set of (shingle, occurrence); those of one text alone can't overlap
            _, column, times = np.unique(_mix(flat + nth.astype(np.uint64) * _GOLD), return_inverse=True, return_counts=True)
            kept = times[column] > 1
            column, owner = column[kept], owner[kept]
            _, column = np.unique(column, return_inverse=True)
            order = np.argsort(column, kind="stable")
            column, owner = column[order], owner[order]
            common = np.zeros((n, n), np.float32)
            for lo in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
                i, j = np.searchsorted(column, [lo, lo + COLUMNS])
                x = np.zeros((n, COLUMNS), np.float32)
                x[owner[i:j], column[i:j] - lo] = 1
                common += x @ x.T
            link = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9 * (1 + size[:, None])
            link &= comp[:, None] != comp[None, :]
            if side[0] != 2:
                link &= side[:, None] != side[None, :]
            label = np.arange(n)
            while True:  # smallest reachable row
                new = np.minimum(label, np.where(link, label[None, :], n).min(1))
                new = new[new]
                if (new == label).all():
                    break
                label = new
            first = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(first, label, ids)
            rows = np.flatnonzero(ids != first[label])
            yield pa.RecordBatch.from_arrays([pa.array(first[label][rows]), pa.array(ids[rows])], names=["a", "b"])

    return run


def _links_in_blocks(groups: DataFrame, parts: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of one component, from exact comparison of all texts of each
    candidate group (texts joined by buckets) whose components differ.

    A group's texts are dealt over blocks of about BLOCK_TEXTS texts and
    BLOCK_SHINGLES shingles, and every pair of blocks is one matrix product of
    the shingles that two of its texts share."""
    n_parts = shuffle_partitions(texts.sparkSession)
    rows = groups.select("id", F.col("component").alias("g")).join(parts, "id", "left").join(texts, "id").select(
        "id", "g", F.coalesce("component", "id").alias("c"), "text")
    rows = cut_lineage(rows)
    words = F.length("text") / F.lit(6)
    blocks = rows.groupBy("g").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_TEXTS)), F.ceil(F.sum(words) / F.lit(BLOCK_SHINGLES)),
        F.lit(1)).cast("bigint").alias("n"))
    dealt = rows.join(blocks, "g").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("n")))
    pairs = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("other")).select(
        F.xxhash64("g", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "id",
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
        "c", "text")
    return pairs.repartition(n_parts, "key").sortWithinPartitions("key").mapInArrow(
        _block_links(threshold), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Classes of near-duplicate texts.

    ``docs`` needs doc_id and text; further columns are ignored. Returns a row
    for every doc_id: doc_id, rep_id (the smallest doc_id with the same words),
    component_id (the smallest doc_id reachable by links of similarity >=
    ``threshold`` between texts), component_size (documents of it) and kept
    (doc_id = component_id).

    Words are runs of 0-9, a-z and non-ASCII characters after lower-casing
    A-Z. A text of one to four words is one shingle of them all. A text
    without words (null, empty, punctuation) links with nothing. Repeated rows
    of a doc_id count once (the largest text stands for them); rows
    without a doc_id are left out. An empty table gives no rows. A task holds
    all words of a text at once: signing costs about 35 times its size, the
    comparison of two texts about 55 times that of one.

    Banding may miss a pair (5e-5 at 0.8, less above); nothing is capped.
    """
    raw = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")) \
        .filter("id IS NOT NULL")
    signed = cut_lineage(raw.mapInArrow(_signatures, "id bigint, words binary, keys array<bigint>"))
    if not signed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():  # repeated rows
        raw = cut_lineage(raw.groupBy("id").agg(F.max("text").alias("text")))
        signed = cut_lineage(raw.mapInArrow(_signatures, "id bigint, words binary, keys array<bigint>"))
    words = signed.select("id", "words")
    reps = words.filter("words IS NOT NULL").groupBy("words").agg(F.min("id").alias("rep"))
    member = cut_lineage(
        split_join(words.filter("words IS NOT NULL"), cut_lineage(reps), ["words"]).select("id", "rep")
        .union(words.filter("words IS NULL").select("id", F.col("id").alias("rep"))))
    firsts = member.filter("id = rep").select("id")
    rows = cut_lineage(signed.filter("keys IS NOT NULL").select("id", "keys").join(firsts, "id", "left_semi")
                       .select("id", F.explode("keys").alias("key")))
    buckets = rows.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut_lineage(rows.join(buckets, "key").select("key", "a", F.col("id").alias("b")))
    pairs = cut_lineage(shared.filter("a <> b").select("a", "b").distinct())
    # the texts that share a bucket, by a filter of fixed size (a wrong bit costs a row that joins nothing)
    texts = cut_lineage(in_cells(raw.filter("text IS NOT NULL"), "id", cells_of(shared.select(F.col("b").alias("id")), "id")))
    found = cut_lineage(_links(pairs, texts, threshold).select("a", "b"))
    # buckets whose members are in different components hold pairs not yet compared
    none = member.select("id", F.col("id").alias("component")).limit(0)
    parts = none if found.isEmpty() else components(found)
    label = shared.select("key", "a", F.col("b").alias("id")).join(parts, "id", "left") \
        .select("key", "a", "id", F.coalesce("component", "id").alias("c"))
    mixed = label.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n")) \
        .filter("lo <> hi AND n > 2").select("key")
    left = cut_lineage(label.join(mixed, "key").filter("a <> id").select("a", F.col("id").alias("b")).distinct())
    if not left.isEmpty():
        more = cut_lineage(_links_in_blocks(components(left), parts, texts, threshold))
        if not more.isEmpty():
            found = cut_lineage(found.union(more))
            parts = components(found)
    whole = cut_lineage(member.join(parts.withColumnRenamed("id", "rep"), "rep", "left")
                        .select("id", "rep", F.coalesce("component", "rep").alias("component")))
    sizes = whole.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return split_join(whole, cut_lineage(sizes), ["component"]).select(
        F.col("id").alias("doc_id"), F.col("rep").alias("rep_id"), F.col("component").alias("component_id"),
        F.col("size").alias("component_size"), (F.col("id") == F.col("component")).alias("kept"))


ORACLE_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - {SHINGLE - 1}))) AS i FROM w WHERE len(ws) > 0)),
c AS (SELECT doc_id, sh, count(*) AS n FROM s GROUP BY 1, 2),
t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS shared
  FROM c a JOIN c b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b
  WHERE shared >= {THRESHOLD} * (x.n + y.n - shared)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
g AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1),
k AS (SELECT ws, min(doc_id) AS rep_id FROM w WHERE len(ws) > 0 GROUP BY 1)
SELECT g.doc_id, coalesce(rep_id, g.doc_id) AS rep_id, component_id,
       count(*) OVER (PARTITION BY component_id) AS component_size, g.doc_id = component_id AS kept
FROM g JOIN w USING (doc_id) LEFT JOIN k USING (ws)
"""
