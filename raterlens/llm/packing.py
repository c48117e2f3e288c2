"""Best-fit packing of tokenised documents: best-two-fit.

A sequence is filled greedily, always with the longest unpacked piece that
fits. Then, while it has a gap, its smallest piece is replaced by the two
unpacked pieces that fit the gap so expanded most tightly.

Pieces of one length are interchangeable, so the sequences follow from the
number of pieces of each length: at most ``capacity`` numbers, however many
documents there are. A filled sequence is repeated until one of its lengths
runs out, which makes the plan a few thousand kinds of sequence. The pieces
then find their places by their rank within their length, without meeting:

1. Every task encodes its documents, cuts them into pieces and numbers the
   pieces of each length. The rows (no ids) are written to the shared folder,
   with an id of the task's output, so the numbers stay fixed.
2. Counts by (output, length) give each output its first rank in a length.
3. A rank's kind of sequence, sequence and offset are looked up in the plan.

Ids come from the tokenizers library: distinct words are encoded once a worker
and runs of them between blanks remembered (bounded), texts with other than
Latin letters encoded whole.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlens.session import cut_lineage

CAPACITY = 2048
END_ID = 0               # stands after every document
CACHE = 600_000          # encoded words, and as many runs between blanks, kept by a worker
STEP_CHARS = 1_000_000   # characters of a long text encoded together

# Letters that are their own canonical composition, with a lower case of one
# character among them, and other characters that the normaliser leaves alone.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
_PLAIN = re.compile(rf"[\t\n\r -~¡-©«-±´¶-¸»¿×÷‐-‧{_LETTERS}]*")
# Split pattern of the pre-tokenizer (fixed value of the file format), for such texts.
_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")


class WordEncoder:
    """Ids of texts as the tokenizers library gives them for a vocabulary file
    whose pre-tokenizer drops white space and keeps no context across it."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encodes distinct words as one text: the tokens of a word share its number."""
        found = self.library.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(np.array(found.word_ids, np.int64)))).tolist()
        self.words.update(zip(words, (ids[a:b] for a, b in zip([0, *ends], ends))))

    def _step(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self._whole(text)
        runs = text.lower().split()
        try:
            return b"".join(map(self.runs.__getitem__, runs))
        except KeyError:
            new = set(runs).difference(self.runs)
        if len(self.runs) + len(new) > CACHE:
            self.runs.clear()
            new = set(runs)
        parts = {r: _WORDS.findall(r) for r in new}
        words = {w for p in parts.values() for w in p}
        if len(self.words) + len(words) > CACHE:
            self.words.clear()
        if unknown := [w for w in words if w not in self.words]:
            self._learn(unknown)
        self.runs.update((r, b"".join(map(self.words.__getitem__, p))) for r, p in parts.items())
        return b"".join(map(self.runs.__getitem__, runs))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids. A long text is cut before a blank,
        where no word, composed character or special token continues."""
        out, at = [], 0
        while len(text) - at > STEP_CHARS:
            cut = min((i for i in (text.find(" ", at + STEP_CHARS), text.find("\n", at + STEP_CHARS)) if i > 0),
                      default=len(text))
            out.append(self._step(text[at:cut]))
            at = cut
        out.append(self._step(text[at:]))
        return b"".join(out)


_encoders: dict[str, WordEncoder] = {}  # of this worker, which serves many tasks


def encoder_of(spec: str) -> WordEncoder:
    if spec not in _encoders:
        _encoders.clear()
        _encoders[spec] = WordEncoder(spec)
    return _encoders[spec]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("output", pa.string()), ("rank", pa.int64())])


def _cut(spec, capacity: int):
    def run(batches):
        encoder, output = encoder_of(spec.value), uuid.uuid4().hex
        end, seen = np.array([END_ID], "<u4").tobytes(), Counter()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc_id, i, at // 4, n, zlib.crc32(part), output, seen[n]))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    return run


def _two_for(free: np.ndarray, room: int, least: int) -> tuple[int, int] | None:
    """The two free lengths with the largest sum in (least, room]."""
    a = np.flatnonzero(free[:room])
    if not len(a):
        return None
    at = np.searchsorted(a, np.minimum(room - a, a), "right") - 1
    at -= (at >= 0) & (a[at] == a) & (free[a] < 2)  # a length of one piece isn't its own partner
    total = np.where(at >= 0, a + a[at], 0)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    return (int(a[best]), int(a[at[best]])) if total[best] > least else None


def fill(free: np.ndarray, capacity: int, whole: bool = False) -> list[int]:
    """One sequence from the free pieces by length; ``free`` is reduced. The
    piece that opens it stays. With ``whole``, two pieces replace another only
    if the sequence is then full."""
    held, gap = [], capacity
    while gap and (fits := np.flatnonzero(free[:gap + 1])).size:
        held.append(int(fits[-1]))
        free[held[-1]] -= 1
        gap -= held[-1]
    while gap and len(held) > 1:
        out = min(held)
        pair = _two_for(free, gap + out, gap + out - 1 if whole else out)
        if not pair:
            break
        held.remove(out)
        free[out] += 1
        for n in pair:
            free[n] -= 1
        held += pair
        gap += out - sum(pair)
    return sorted(held, reverse=True)


def _plan(counts: np.ndarray, capacity: int, whole: bool) -> tuple[int, list]:
    left, used = counts.astype(np.int64), np.zeros(len(counts), np.int64)
    sequence, rows = 0, []
    while left.any():
        uses = Counter(fill(left.copy(), capacity, whole))
        times = min(left[n] // k for n, k in uses.items())
        offset = 0
        for n, k in uses.items():
            rows.append((n, used[n], sequence, k, offset))
            offset += n * k
            left[n] -= times * k
            used[n] += times * k
        sequence += times
    return sequence, rows


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Places for all pieces. ``counts[n]`` is the number of pieces of length n.
    Rows, ordered by (length, first): length, first (rank within the length),
    sequence (of that rank), uses (pieces of the length in each sequence of the
    kind), offset. The rank r lies in sequence + (r - first) // uses. Both
    rules of replacement are tried; the one with fewer sequences stands."""
    _, rows = min((_plan(counts, capacity, whole) for whole in (False, True)), key=lambda x: x[0])
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


_PLACED = pa.schema([*list(_PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _place(places, capacity: int):
    def run(batches):
        length, first, sequence, uses, offset = places.value.T
        stride = np.int64(1) << np.int64(62 - int(capacity).bit_length())
        key = length * stride + first
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, n * stride + rank, "right") - 1
            turn = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence[at] + turn // uses[at]),
                 pa.array(offset[at] + turn % uses[at] * n)], schema=_PLACED)

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs the tokens of all documents into sequences of at most ``capacity``.

    ``docs`` needs doc_id and text; further columns are ignored. ``path`` is a
    file of the tokenizers library (see :class:`WordEncoder`). A document is
    its ids and the id END_ID; only longer ones than ``capacity`` are cut.
    Returns a row for every piece: doc_id, piece (from 0), start (ids before
    it), length, ids_crc32, sequence_id (from 0) and offset (gapless from 0).

    Null and empty texts are the end id alone. Every row is a document, so
    repeated rows and null ids are packed as often as they occur. An empty
    table gives no rows. A task holds the ids of one text at a time (4 bytes a
    token) and the runs of STEP_CHARS characters.
    """
    sc = docs.sparkSession.sparkContext
    with open(path, encoding="utf-8") as f:
        spec = sc.broadcast(f.read())  # bounded by the vocabulary file
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut_lineage(rows.mapInArrow(
        _cut(spec, capacity), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "output string, rank bigint"))
    counts = cut_lineage(pieces.groupBy("output", "length").agg(F.count(F.lit(1)).alias("n")))
    by_length = np.zeros(capacity + 1, np.int64)
    for n, k in counts.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        by_length[n] = k
    places = sc.broadcast(plan(by_length, capacity))
    before = Window.partitionBy("length").orderBy("output").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = pieces.join(firsts, ["output", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("rank"))
    return ranked.mapInArrow(
        _place(places, capacity), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "sequence_id bigint, offset bigint")
