"""Best-two-fit packing, conversation prefix trie and filter audit against
plain computations."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from raterlens.llm import filter_audit, packing, prefix_trie

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, source string, rank string, length string, hash string, n string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()


# --- packing -----------------------------------------------------------------

def test_word_encoder_equals_the_library(library):
    encoder = packing.WordEncoder(open(PATH, encoding="utf-8").read())
    plain = "abcXYZ'sStTreveVEmMllLLdD 0129.,!?\"-–’“\n\t\r  éÉüßµªºÀıŉŸſ¡§©«¬®¯°±´¶·¸»¿×÷"
    odd = plain + "ẞİƁǅΣςσ字ガカ½²¼́  \x85\x0b\x1cȺ<|>"
    r = random.Random(5)
    texts = ["", " ", "it's", "IT'S'LL", "a<|endoftext|>b <|startoftext|>"]
    for alphabet in (plain, odd):
        texts += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3_000)]
    for t in texts:
        assert encoder.encode(t) + bytes(4) == ids_of(library, t), repr(t)


def test_word_encoder_cuts_long_texts_and_forgets(library, monkeypatch):
    monkeypatch.setattr(packing, "STEP_CHARS", 40)
    monkeypatch.setattr(packing, "CACHE", 60)
    encoder = packing.WordEncoder(open(PATH, encoding="utf-8").read())
    r = random.Random(6)
    text = " ".join("".join(r.choice("abcdé'!1") for _ in range(r.randint(1, 8))) for _ in range(800))
    assert encoder.encode(text) + bytes(4) == ids_of(library, text)
    assert encoder.encode("x" * 500) + bytes(4) == ids_of(library, "x" * 500)


def test_best_two_fit_replaces_the_smallest():
    free = np.zeros(101, np.int64)
    for n in (60, 30, 21, 17):  # 60 + 30 leaves 10; instead of 30: 21 + 17
        free[n] += 1
    assert packing.fill(free.copy(), 100, whole=True) == [60, 30]
    assert packing.fill(free, 100) == [60, 21, 17]
    assert free[30] == 1 and free.sum() == 1
    free = np.zeros(101, np.int64)
    free[[70, 20]] = 1
    free[15] = 1  # a single 15 can't be both of the two
    assert packing.fill(free, 100) == [70, 20]


def test_plan_places_every_piece_once_and_is_tight():
    r = np.random.default_rng(3)
    for _ in range(20):
        counts = np.zeros(65, np.int64)
        lengths = r.integers(1, 65, r.integers(1, 25))
        np.add.at(counts, lengths, r.integers(1, 300, len(lengths)))
        places = packing.plan(counts, 64)
        bins = defaultdict(list)
        for n in range(1, 65):
            rows = places[places[:, 0] == n]
            for rank in range(counts[n]):
                _, first, sequence, uses, offset = rows[np.searchsorted(rows[:, 1], rank, "right") - 1]
                bins[sequence + (rank - first) // uses].append((offset + (rank - first) % uses * n, n))
        for held in bins.values():
            at = 0
            for offset, n in sorted(held):
                assert offset == at
                at += n
            assert at <= 64
        assert sum(map(len, bins.values())) == counts.sum()
        # first-fit decreasing, piece by piece, needs no fewer
        gaps = []
        for n in np.repeat(np.arange(65), counts)[::-1]:
            fits = [i for i, g in enumerate(gaps) if g >= n]
            if fits:
                gaps[fits[0]] -= n
            else:
                gaps.append(64 - n)
        assert len(bins) <= len(gaps) * 1.02 + 1


def check_packing(rows, texts, library, capacity):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc_id, text in texts.items():
        ids, at = ids_of(library, text), 0
        for i, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r.piece)):
            part = ids[4 * at:4 * (at + capacity)]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (i, at, len(part) // 4, zlib.crc32(part))
            at += r.length
        assert 4 * at == len(ids)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_packing_of_the_table(spark, sf_small, library):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    n, least = check_packing(rows, texts, library, 2048)
    assert n <= least + 1


def test_packing_edge_cases(spark, library):
    long = "a b, " * 30_000
    data = [(1, None), (2, ""), (3, long), (4, "x"), (5, "字 " * 50)]
    docs = spark.createDataFrame([(i, t, "s", "r", "l", "h", "n") for i, t in data], DOCS)
    n, least = check_packing(packing.pack(docs, PATH, 64).collect(), dict(data), library, 64)
    assert n <= least + 1
    again = spark.createDataFrame([(None, "x", "", "", "", "", ""), (7, "x", "", "", "", "", "")] * 3, DOCS)
    rows = packing.pack(again, PATH, 64).collect()
    assert Counter(r.doc_id for r in rows) == {None: 3, 7: 3}
    assert sorted(r.offset for r in rows) == [i * rows[0].length for i in range(6)]
    assert packing.pack(docs.limit(0), PATH).collect() == []


# --- prefix trie ---------------------------------------------------------------

def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    made = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        made[c] = [*turns.get(base, [])[:h], *turns[c][h:]]
    members = defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = []
    for path, m in members.items():
        below = [p for p in members if p[:len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        ends = ",".join(str(c) for c in sorted(m) if len(made[c]) == len(path))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(kids),
                    sum(not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below) for p in below),
                    sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows],
                               "conv_id bigint, turn bigint, role string, text string, block string, key1 string")
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=repr)


def test_trie_of_random_conversations(spark):
    r = random.Random(11)
    rows = []
    for c in [*range(-12, 40), 1005, 1007]:
        n = r.choice([1, 2, 4, 5, 9, 14])
        same = r.random() < 0.5  # many share long prefixes
        for t in range(n):
            text = "é" if same and r.random() < 0.9 else r.choice(["a", "bb", "", None])
            rows.append((c, None if t == 0 and r.random() < 0.3 else t, r.choice(["user", "user", None]), text))
    rows += [(None, 0, "user", "of no conversation")]
    r.shuffle(rows)
    assert trie_of(spark, rows) == plain_trie(rows)


def test_trie_edge_cases(spark):
    assert trie_of(spark, []) == []
    # 3 takes up to 3 of its own turns off and has no base: it ends at the root
    turnless = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(turnless, 0, None, None)]
    assert trie_of(spark, rows) == plain_trie(rows)
    assert len(trie_of(spark, rows)) == 1
    # copies of one conversation, one of them much longer, a long text, repeated rows
    rows = [(5 * c, t, "user", f"{t % 3}") for c in range(30) for t in range(9)]
    rows += [(5, t, "user", f"{t % 3}") for t in range(9, 60)] + [(500, 0, "user", "long " * 40_000)]
    rows += [(505, 1, "user", "twice")] * 2
    assert trie_of(spark, rows) == plain_trie(rows)


def test_ends_are_listed_by_several_tasks(spark):
    convs = spark.range(1, 25_001).select(F.lit(2).alias("depth"), F.lit(7).cast("bigint").alias("key1"),
                                          F.lit(9).cast("bigint").alias("key2"), F.col("id").alias("conv_id"))
    (row,) = prefix_trie.ends_of(convs).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, range(1, 25_001))).encode()).hexdigest()


# --- filter audit ----------------------------------------------------------------

def plain_audit(docs, labels):
    import re

    marks = {name: {i for i, q, t in labels if (q if name == "good" else t) == 1} for name in ("good", "toxic")}
    rows = []
    for doc_id, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        if doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u, _ in docs):
            fails.add("E")
        rows.append((source or "", fails, doc_id in marks["good"], doc_id in marks["toxic"]))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            alive = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if f in r[0]]
                alive = [r for r in alive if f not in r[0]]
                shapley[part, f] += len(gone)
                out[part, order, step] = (len(alive), len(gone), sum(f in r[0] for r in mine) - len(gone),
                                          sum(r[0] == {f} for r in mine), sum(r[1] for r in gone),
                                          sum(r[2] for r in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_of(spark, docs, labels):
    d = spark.createDataFrame([(*x, "r", "l", "h", "n") for x in docs], DOCS)
    l_ = spark.createDataFrame([(*x, 1) for x in labels], "doc_id bigint, quality int, toxic int, n int")
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(d, l_).collect()}


def test_audit_of_random_documents(spark):
    r = random.Random(2)
    words = ["one", "Two", "THREE", "vier#", "fünf", "sechs x", "sieben\x0bacht", "a\x1cb"]
    texts = [" ".join(r.choices(words, k=r.choice([0, 3, 210]))) for _ in range(12)]
    texts += [" ".join(f"w{i}" for i in range(250)), "\t".join(f"W{i}" for i in range(250)), None, ""]
    docs = [(i if r.random() < 0.95 else None, r.choice(texts), r.choice(["s", "", None])) for i in range(150)]
    docs += [(3, docs[3][1], "s"), (3, docs[3][1], "s"), (3, "another text", "s")]
    labels = [(r.choice([None, *range(160)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(120)]
    assert audit_of(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_edge_cases(spark, monkeypatch):
    assert audit_of(spark, [], [(1, 1, 1)]) == {}
    docs = [(1, "x " * 300_000, None)]
    assert audit_of(spark, docs, []) == plain_audit(docs, [])
    # a hash of most rows is salted
    monkeypatch.setattr("raterlens.llm.common.HEAVY", 8)
    docs = [(i, "the same" if i % 3 else f"own {i}", "s") for i in range(300)]
    assert audit_of(spark, docs, []) == plain_audit(docs, [])


def test_equal_hashes_of_different_texts_are_no_copies(spark, monkeypatch):
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *c: F.lit(5).cast("bigint"))
    docs = [(1, "a", "s"), (2, "b", "s"), (3, "a", "s")]
    assert audit_of(spark, docs, []) == plain_audit(docs, [])
