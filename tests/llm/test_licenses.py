"""Licence bodies, long texts and the base columns against DuckDB."""

import duckdb
import pytest

from raterlens.llm import licenses
from raterlens.llm.common import LOWER, UPPER, ascii_words
from raterlens.llm.queries import QUERIES

DOCS = "doc_id long, text string"

BODIES = {
    "apache": "2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby "
              "grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license "
              "to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute "
              "the Work and such Derivative Works in Source or Object form. 3. Grant of Patent License.",
    "mpl": "3.1. Distribution of Source Form. All distribution of Covered Software in Source Code Form, including any "
           "Modifications that You create or to which You contribute, must be under the terms of this License.",
    "isc": "Copyright (c) 2020 Someone\nPermission to use, copy, modify, and distribute this software for any purpose with "
           "or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
           "in all copies.",
    "bsd": "1. Redistributions of source code must retain the above copyright\n# notice, this list of conditions and the "
           "following disclaimer.",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
             "and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
             "distribute, execute, and transmit the Software",
    "agpl": "Notwithstanding any other provision of this License, if you modify the Program, your modified version must "
            "prominently offer all users interacting with it remotely through a computer network (if your version "
            "supports such interaction) an opportunity to receive the Corresponding Source of your version",
}


def test_bodies_get_their_label_alone(spark):
    names = sorted(BODIES)
    rows = spark.createDataFrame([(i, "Some words before. " * 40 + BODIES[n] + " and after" * 40)
                                  for i, n in enumerate(names)], DOCS)
    got = {r.doc_id: r for r in licenses.license_scan(rows).collect()}
    assert [got[i].labels for i in range(len(names))] == names
    assert all(r.base_labels == "" and r.n_base == 0 and r.score >= licenses.MIN_COVER for r in got.values())


def test_each_template_covers_itself():
    sam = licenses.Automaton(licenses.TEMPLATES, licenses.PHRASES)
    for t, (_, text) in enumerate(licenses.TEMPLATES):
        chain = sam.scan([ascii_words(text)])[1][t]
        assert sum(hi - lo + 1 for lo, hi, _ in chain) == len(sam.words[t])


def test_occurrences_of_states_against_brute_force():
    sam = licenses.Automaton(licenses.TEMPLATES, licenses.PHRASES)
    for t, words in enumerate(sam.words):
        for i in range(len(words) - 2):
            run = words[i:i + 3]
            want = {(u, j + 2) for u, w in enumerate(sam.words) for j in range(len(w) - 2) if w[j:j + 3] == run}
            assert set(sam.ends[sam._walk(run)]) == want


def test_words_strewn_over_a_long_text_cover_nothing_together(spark):
    words = BODIES["apache"].split()
    strewn = " ".join(" ".join(words[i:i + 4]) + " other" * 80 for i in range(0, len(words), 4))
    r = licenses.license_scan(spark.createDataFrame([(1, strewn)], DOCS)).first()
    assert r.labels == "" and 0 < r.score < licenses.MIN_COVER


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 20])
def test_steps_give_the_words_of_the_whole(step):
    for text in [None, "", "!!", "a", " MIT  License, ", "Ünïcode ÀÉ ß 日本 🤔 mit license" * 9, "x" * 300 + " y"]:
        assert [w for words in licenses.word_steps(text, step) for w in words] == ascii_words(text)


def test_very_long_text_is_read_in_steps(spark, monkeypatch):
    text = "the MIT License and " * 300_000 + BODIES["isc"]
    r = licenses.license_scan(spark.createDataFrame([(1, text)], DOCS)).first()
    assert len(text) > 4 * licenses.STEP and r.n_words == len(ascii_words(text))
    assert (r.n_base, r.first_word, r.last_word) == (300_000, 1, 299_999 * 4 + 1)
    assert r.base_labels == "mit" and r.labels == "isc,mit"


BASE_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words,
        list_filter(range(len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS mit,
        list_filter(range(len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS apache,
        list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS gpl
      FROM w)
SELECT doc_id, n_words, len(mit) + len(apache) + len(gpl) AS n_base, list_min(mit || apache || gpl) AS first_word,
  list_max(mit || apache || gpl) AS last_word,
  concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END,
            CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
FROM p"""


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_base_columns_against_sql(spark, size):
    sf = f"/root/testdata/{size}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.execute(BASE_SQL).fetchall())
    name = next(q for q in QUERIES if q.startswith("op9_"))
    got = QUERIES[name](spark, sf).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(map(tuple, got.collect())) == want and any(r[2] for r in want)
