"""Byte-level BPE with a pair occurrence index.

The merges of a partition's distinct pieces are found together: an index maps
each adjacent pair of tokens to all its positions in the partition's pieces,
and the pairs present are taken in ascending rank; all positions of a pair
merge (left to right where they overlap) in array operations and the lists of
the pairs beside them are updated.
Merging a rank only makes pairs of higher ranks (checked when the vocabulary
is read), so this gives what merging each piece alone gives.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Split pattern of the byte-level pre-tokenizer (fixed value of the file format).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# The same split for texts of ASCII and Latin letters alone, where the standard
# library's faster engine has the same classes.
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[\t\n\r -~{_LATIN}]*")
_PLAIN_PIECES = re.compile(
    rf" ?[{_LATIN}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
CACHE_PIECES = 250_000   # encoded pieces kept by a worker
STEP_CHARS = 4_000_000   # texts encoded together; a longer text is a step of its own


def pieces_of(text: str) -> list[str]:
    return (_PLAIN_PIECES if _PLAIN.fullmatch(text) else PIECES).findall(text)


def byte_characters() -> dict[str, int]:
    """Characters that stand for bytes in the vocabulary: printable Latin-1
    characters stand for themselves, the other bytes follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and special tokens of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], byte_characters()
        ids = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.tokens[i] = bytes(byte[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in byte.items():
            self.byte_ids[b] = ids[c]
        made: dict[int, int] = {}
        n = len(model["merges"])
        self.left, self.right, self.new = (np.zeros(n, np.int64) for _ in range(3))  # by rank
        for rank, pair in enumerate(model["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            self.left[rank], self.right[rank], self.new[rank] = ids[x], ids[y], ids[x + y]
            made[ids[x + y]] = rank  # the last merge that makes the token
        if any(made.get(t, -1) >= rank for side in (self.left, self.right) for rank, t in enumerate(side.tolist())):
            raise ValueError("a merge uses a token that a later merge makes")
        pairs = self.left * len(self.tokens) + self.right
        self.order = np.argsort(pairs)
        self.pairs = pairs[self.order]

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens (-1: no merge; negative tokens: none)."""
        pair = x * len(self.tokens) + y
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pair) & (x >= 0) & (y >= 0), self.order[at], -1)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each piece.

        The pieces stand behind each other with walls (-1) between; a position
        is where a token begins. ``index`` holds, by rank, lists of positions
        of the pair; a list may hold positions whose pair has gone by the time
        its rank is due, so the tokens are looked at again."""
        if not pieces:
            return []
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
        token = self.byte_ids[np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)]
        token[ends] = -1
        n = len(token)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(rank, at):
            """File positions under their ranks; new ranks become active."""
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, part in zip(rank[cuts].tolist(), np.split(at, cuts[1:])):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(part)

        rank = self.ranks(token[:-1], token[1:])
        at = np.flatnonzero(rank >= 0)
        if len(at):
            add(rank[at], at)
        while heap:
            r = heapq.heappop(heap)
            x, y, new = self.left[r], self.right[r], self.new[r]
            i = np.unique(np.concatenate(index.pop(r)))
            i = i[token[i] == x]
            j = after[i]
            i, j = i[token[j] == y], j[token[j] == y]
            if x == y and len(i):  # overlapping pairs: every second one of a run, from the left
                first = np.flatnonzero(np.append(True, i[1:] != j[:-1]))
                place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
                i, j = i[place % 2 == 0], j[place % 2 == 0]
            if not len(i):
                continue
            k = after[j]
            token[i], token[j] = new, -2
            after[i], before[k] = k, i
            h = before[i]
            previous = np.where(h >= 0, token[h], -1)
            left = np.where(previous == new, -1, self.ranks(previous, token[i]))  # two new ones: filed once, as a right pair
            right = self.ranks(token[i], token[after[i]])
            rank, at = np.concatenate([left, right]), np.concatenate([h, i])
            if (rank >= 0).any():
                add(rank[rank >= 0], at[rank >= 0])
        live = token >= 0
        ids = token[live].astype("<u4").tobytes()
        stop = (np.cumsum(live)[ends] * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *stop[:-1]], stop)]


class Encoder:
    """Encodes texts with a vocabulary, remembering pieces (bounded)."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(
            vocabulary.special, key=len, reverse=True)) + ")") if vocabulary.special else None
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in vocabulary.special.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = []
        for t in texts:
            parts = self.split.split(t) if self.split and any(s in t for s in self.special) else [t]
            cut.append([(p, None) if i % 2 else (None, pieces_of(p)) for i, p in enumerate(parts)])
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        known = self.known
        new = list({p for parts in cut for _, pieces in parts if pieces for p in pieces if p not in known})
        known.update(zip(new, self.v.encode_pieces(new)))
        return [b"".join(self.special[s] if s is not None else b"".join(map(known.__getitem__, pieces))
                         for s, pieces in parts) for parts in cut]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                     ("decoded_sha256", pa.string())])


def _steps(ids: list, texts: list):
    """Cut a batch into steps of about STEP_CHARS characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= STEP_CHARS or i == len(texts) - 1:
            yield ids[lo:i + 1], texts[lo:i + 1]
            lo, size = i + 1, 0


def _run(vocabulary, digests: bool):
    def run(batches):
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for ids, part in _steps(batch.column(0).to_pylist(), texts):
                codes = encoder.encode(part)
                if digests:
                    cols = [ids, [len(c) // 4 for c in codes], [hashlib.sha256(c).hexdigest() for c in codes],
                            [hashlib.sha256(encoder.decode(c).encode("utf-8")).hexdigest() for c in codes]]
                else:
                    cols = [ids, [len(c) // 4 for c in codes], codes, [encoder.decode(c) for c in codes]]
                schema = _DIGEST if digests else _OUT
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def _mapped(docs: DataFrame, path: str, digests: bool, schema: str) -> DataFrame:
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))  # bounded by the vocabulary file
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_run(vocabulary, digests), schema)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Tokens of every whole text and the text they decode to.

    ``docs`` needs doc_id and text; further columns are ignored. Returns a
    row for every input row: doc_id, n_tokens, ids (binary, little-endian
    unsigned 32-bit), decoded. ``path`` is a byte-level BPE file of the
    tokenizers library; its special tokens are recognised inside texts.

    Null text counts as empty: 0 tokens, decoded ''. Repeated rows and null
    ids pass through; an empty table gives no rows. Texts are encoded in steps
    of about STEP_CHARS characters; a longer text is a step of its own and
    costs its task about 25 times its size.
    """
    return _mapped(docs, path, False, "doc_id bigint, n_tokens bigint, ids binary, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As :func:`encode_decode`, with SHA-256 digests taken inside the tasks
    in place of the ids and the decoded text."""
    return _mapped(docs, path, True, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
