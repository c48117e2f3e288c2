"""The corpus pipeline, stage by stage, against brute force."""

import hashlib
import os
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as cp
from raterlens.llm import langid, minhash, mixing
from raterlens.llm.common import ascii_words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "kept", "component"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark, sf_small):
    """The small documents with extra columns whose names the stages use, and
    odd rows: null and empty texts, copies, near copies and a repeated row."""
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x", 1)
            for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    text = base[0][1]
    odd = [(9001, None, None, None, 0, None, None), (9002, "", "en", "a", 0, "x", 1), (9003, "12 !!", "en", "a", 5, "x", 1),
           (9004, text.upper(), "en", "a", 9, "x", 1), (9005, base[1][1], "en", "a", 9, "x", 1),
           (9005, base[1][1], "en", "a", 9, "x", 1), (9006, base[2][1] + " more", "en", None, 9, "x", 1)]
    return spark.createDataFrame(base + odd, SCHEMA)


def test_stages(spark, docs, sf_small):
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5 and all(callable(f) for _, f in cp.STAGES)
    have = [tuple(r) for r in docs.collect()]

    out = cp.language(spark, docs, sf_small)
    assert out.columns == COLUMNS
    known = {r.doc_id: r for r in langid.identify(docs).collect()}
    least = cp.least_score(4)
    want = [r for r in have if known[r[0]].lang_pred != "und" and known[r[0]].score >= least]
    assert rows_of(out) == sorted(want, key=repr)
    assert {9001, 9002, 9003}.isdisjoint(r[0] for r in want) and len(want) >= len(have) - 6

    one = spark.createDataFrame(want, SCHEMA)
    norm = {r[0]: re.sub("[A-Z]", lambda m: m[0].lower(), r[1]) for r in want}
    best = {}
    for i, t in norm.items():
        best[t] = max(i, best.get(t, i))
    want = list({r[0]: r for r in want if best[norm[r[0]]] == r[0]}.values())
    out = cp.exact_copies(spark, one, sf_small)
    assert out.columns == COLUMNS and rows_of(out) == sorted(want, key=repr)

    bags = {r[0]: minhash.shingle_counts(ascii_words(r[1])) for r in want}
    comp = {i: i for i in bags}
    changed = True
    links = [(a, b) for a in bags for b in bags if a < b and minhash.similarity(bags[a], bags[b]) >= 0.8]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if (comp[a], comp[b]) != (low, low):
                comp[a] = comp[b] = low
                changed = True
    two = spark.createDataFrame(want, SCHEMA)
    want = [r for r in want if comp[r[0]] == r[0]]
    out = cp.near_copies(spark, two, sf_small)
    assert out.columns == COLUMNS and rows_of(out) == sorted(want, key=repr)

    three = spark.createDataFrame(want, SCHEMA)
    copies = {r.doc_id: r.copies for r in mixing.source_mix(three).collect()}
    want = [r for r in want for _ in range(copies[r[0]])]
    out = cp.source_weights(spark, three, sf_small)
    assert out.columns == COLUMNS and rows_of(out) == sorted(want, key=repr) and want

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter(tuple(r) for r in cp.tokens(spark, spark.createDataFrame(want, SCHEMA), sf_small)
                  .select("doc_id", "n_tokens", "ids", "decoded_sha256").collect())
    ids = {r[0]: lib.encode(r[1], add_special_tokens=False).ids for r in want}
    assert got == Counter((r[0], len(ids[r[0]]), np.array(ids[r[0]], "<u4").tobytes(),
                           hashlib.sha256(r[1].encode()).hexdigest()) for r in want)


def test_run_and_registration(spark, sf_small):
    queries = __spark_entry__.queries()
    assert queries["pipeline"] is cp.run
    assert {int(n[2:].split("_")[0]) for n in queries if re.match(r"op\d+_", n)} == set(range(1, 11))
    out = cp.run(spark, sf_small)
    n = spark.read.parquet(f"{sf_small}/documents.parquet").count()
    assert 0.5 * n < out.select("doc_id").distinct().count() <= n


def test_empty_documents_pass(spark, docs, sf_small):
    frame = docs.limit(0)
    for name, stage in cp.STAGES:
        frame = stage(spark, frame, sf_small)
        assert frame.count() == 0, name


def test_the_rest_imports_without_this_package():
    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name == 'corpus_pipeline' or name.startswith('raterlens.llm'):\n"
            "            raise ModuleNotFoundError(name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "q, o = e.queries(), e.oracle_sql()\n"
            "assert len(q) > 90 and set(o) <= set(q) and not any(n.startswith('op') for n in q if n[2:3].isdigit())\n"
            "assert 'pipeline' not in q\n")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
