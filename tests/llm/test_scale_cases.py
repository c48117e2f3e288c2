"""Long texts, number tables, many labels and hot keys."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from raterlens.llm import bpe, common, exact_dedup, html_extract, langid, minhash, mixing, pii, toxicity

DOCS = "doc_id long, text string, lang string"


def pseudonymised(spark, *texts):
    d = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS)
    return [r for r in pii.pseudonymise(d).orderBy("doc_id").collect()]


# -- pseudonyms


def test_addresses_of_many_labels(spark):
    got = pseudonymised(spark, "x@" + "a." * 50_000, "x@" + "a." * 50_000 + "com", "rhokk@" + "aa." * 50_000,
                        "rhokk@mail.example.org. And rhokk@a-b.example.com-x")
    assert [r.n_values for r in got] == [0, 0, 1, 2]
    assert got[0].text == "x@" + "a." * 50_000 and "rhokk" not in got[2].text + got[3].text
    assert got[3].text.endswith("@a-b.example.com-x")


def test_lists_of_years_and_number_tables_are_no_cards(spark):
    r = random.Random(3)
    texts = [" ".join(map(str, range(y, y + n))) for y in range(1800, 2100, 7) for n in (4, 5, 8, 30)]
    for top in (10 ** 3, 10 ** 4, 10 ** 5, 10 ** 6):
        texts += [" ".join(str(r.randrange(top)) for _ in range(8_000))]
        texts += [" ".join(str(r.randrange(top // 10, top)) for _ in range(8_000))]
    for was, row in zip(texts, pseudonymised(spark, *texts)):
        assert row.text == was and row.n_values == 0, was[:60]


def test_a_very_long_number_table_takes_seconds(spark):
    r = random.Random(4)
    table = " ".join(str(r.randrange(10 ** 4)) for _ in range(100_000))
    pseudonymised(spark, "warm 4111 1111 1111 1111")
    start = time.time()
    (row,) = pseudonymised(spark, table)
    assert row.text == table and time.time() - start < 30


def test_cards_in_all_their_shapes(spark):
    texts = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111 99", "3782 822463 10005",
             "3056 930902 5904", "6304 0000 0000 0000 000", "4111 1111 1111 1111 5500 0000 0000 0004",
             "2024 4111 1111 1111 1111 12 27 123", " ".join(["4111 1111 1111 1111"] * 40)]
    for was, row in zip(texts, pseudonymised(spark, *texts)):
        assert row.n_values == max(1, sum(c.isdigit() for c in was) // 16 if "5500" in was or len(was) > 99 else 1), was
        assert len(row.text) == len(was) and row.text != was
    kept = ["9111 1111 1111 1117", "4111 1111 1111 1112", "1111 4111 1111 1111 1111 2222 3333 4444 5555"]
    assert [r.text for r in pseudonymised(spark, *kept)] == kept


# -- language


def test_every_label_is_learnt(spark):
    """300 labels: none is left out for its place in the alphabet."""
    rows = [(12 * i + j, chr(0x4E00 + i) * 30 + " " + chr(0x5E00 + i) * 30, f"l{i:03d}") for i in range(300) for j in range(12)]
    net = langid.train(spark.createDataFrame(rows, DOCS), docs_per_language=5)
    assert net["labels"] == [f"l{i:03d}" for i in range(300)]


def test_documents_a_label_shrink(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_DOCS", 40)
    read = []
    fit = langid.ByteCNN.fit
    monkeypatch.setattr(langid.ByteCNN, "fit", lambda self, x, y, **k: read.append(np.bincount(y)) or fit(self, x, y, **k))
    rows = [(i, f"some text of number {i}", "ab"[i % 2]) for i in range(400)]
    langid.train(spark.createDataFrame(rows, DOCS))
    assert (read[0] <= 20 * langid.TRAIN_WINDOWS).all()


@pytest.mark.parametrize("languages,even", [(2, 2), (4, 4), (20, 20)])
def test_rejection_is_relative_to_chance(languages, even):
    least = cp.least_score(languages)
    assert 1 / even < least  # chance is rejected
    assert least < 0.6 and (languages == 2 or least < 0.5 + 1e-9)  # half of a text in one language is enough
    assert languages < 20 or least < 0.25  # as are four languages in equal parts among twenty
    assert cp.least_score(1) == 0.0 and cp.least_score(4) == pytest.approx(0.35)


# -- exchange helpers


def test_filter_of_fixed_size_keeps_all_keys(spark):
    keys = spark.range(0, 100_000, 7).select(F.col("id").cast("string").alias("k"))
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("__bit2"))
    cells = common.cells_of(keys, "k")
    assert cells.count() <= common.CELLS
    got = common.in_cells(rows, "k", cells)
    assert got.columns == rows.columns
    assert keys.join(got, "k", "left_anti").count() == 0
    assert got.count() < 1.02 * keys.count()
    assert common.in_cells(rows, "k", common.cells_of(keys.limit(0), "k")).count() == 0


def test_split_join_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 8)
    rows = [("hot", i) for i in range(900)] + [(f"k{i % 40}", i) for i in range(300)]
    left = spark.createDataFrame(rows, "k string, v long")
    right = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(30))], "k string, w long")
    got = common.split_join(left, right, ["k"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_golomb_codes_start_at_the_owner(spark):
    base = 199 * 2 ** 48 // 200
    v = np.unique(np.random.default_rng(0).integers(base, 2 ** 48, 250, dtype=np.uint64))
    code = exact_dedup.golomb_encode(v)
    assert (exact_dedup.golomb_decode(code) == v).all()
    assert 8 * (len(code) - 20) / len(v) < np.log2(2 ** 48 / 200 / 250) + 2.5


# -- pages


STORY = "One sentence of a story that is long enough to be read as content of the page. " * 3


@pytest.mark.parametrize("page,text", [
    ("<p>Hello <script>var a = '<p>';</script> world and <button>b</button> more</p>", "Hello world and more"),
    ("<article><p>By <math><mi>x</mi></math> we mean<svg><text>pic</text></svg> this.</p></article>", "By x we mean this."),
    (f"<div id='ad-free-article'><p>{STORY}</p><p>{STORY}</p></div>", f"{STORY.strip()}\n\n{STORY.strip()}"),
    (f"<main><div class='reply'><p>{STORY}</p></div></main>", STORY.strip()),
    (f"<div id='content'><h1>T</h1><div class='comment-body'><p>{STORY}</p></div></div>", f"T\n\n{STORY.strip()}"),
    (f"<body><nav><a href='/'>Home</a><div><p>{STORY}</p></div></body>", STORY.strip()),
    (f"<article><p>{STORY}</p><h2>Sources</h2><ul>" + "<li><a href='#'>A book</a></li>" * 3 + "</ul></article>",
     f"{STORY.strip()}\n\nSources\n\nA book\n\nA book\n\nA book"),
    (f"<article><p>{STORY}</p></article><div class='comments'><p>{STORY}{STORY}</p></div>", STORY.strip()),
    (f"<article><p>{STORY}</p><noscript><p>no script</p></noscript><p>End <button>go</p><p>of it.</p></article>",
     f"{STORY.strip()}\n\nEnd\n\nof it."),
])
def test_page_shapes(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("page", ["<a " * 20_000, "<div>" * 20_000 + "</section>" * 2_000 + STORY, "<" * 60_000,
                                  "<div class=x>" * 5_000 + STORY + "</div>" * 5_000, f"<p>{STORY}</p>" * 1_000,
                                  "<svg><text>" * 10_000 + STORY, "&amp;" * 30_000, "<!--" * 20_000])
def test_large_and_deep_pages_take_seconds(page):
    start = time.time()
    html_extract.main_text(page)
    assert time.time() - start < 2


# -- toxicity


def test_risk_gradient_against_finite_differences(monkeypatch):
    """A first step of the fit goes down the plain risk, whose gradient is taken by differences."""
    r = np.random.default_rng(0)
    x_pos, x_un = (r.random((40, 6)) < 0.5).astype(np.float32), (r.random((90, 6)) < 0.3).astype(np.float32)
    prior = 0.2

    def risk(theta):
        z = [x.astype(float) @ theta[:6] + theta[6] for x in (x_pos, x_un)]
        negative = np.logaddexp(0, z[1]).mean() - prior * np.logaddexp(0, z[0]).mean()
        assert negative >= 0
        return prior * np.logaddexp(0, -z[0]).mean() + negative

    start = np.append(np.zeros(6), np.log(prior / (1 - prior)))
    slope = np.array([(risk(start + 1e-5 * e) - risk(start - 1e-5 * e)) / 2e-5 for e in np.eye(7)])
    monkeypatch.setattr(toxicity, "STEPS", 1)
    w, b = toxicity.nnpu_fit(x_pos, x_un, prior)
    step = np.append(w, b) - start  # a first step of Adam is the sign of the gradient; weights stay non-negative
    want = np.maximum(-toxicity.LEARNING_RATE * np.sign(slope[:6]), 0)
    assert np.abs(slope[:6]).min() > 1e-4 and np.allclose(step[:6], want, atol=1e-4)


def test_cached_scores_equal_a_plain_sum(spark):
    model = {"features": [(b"bad", 1), (b"bad", 2), (b"ugl*", 1), (b"worse*", 1)], "weights": np.array([1.0, 0.5, 2.0, 0.25]),
             "bias": -1.5, "prior": 0.1}
    texts = ["", None, "bad", "Bad BAD ugly", "ugl uglier worse worsening", "good words only", "x " * 50_000 + "bad"]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in toxicity.score_toxicity(rows, model=model).collect()}
    for i, t in enumerate(texts):
        have = set(toxicity.text_features(t))
        z = model["bias"] + sum(w for f, w in zip(model["features"], model["weights"]) if f in have)
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-z))) and got[i].predicted == (got[i].score >= 0.7)


@pytest.fixture(scope="module")
def long_texts(spark):
    """Two copies of a text of two million characters, one whose last 200 words
    are others, and a short text."""
    rng = np.random.default_rng(21)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(4000)])
    many = rng.choice(words, 340_000)
    near = many.copy()
    near[-200:] = "zebra"  # only the end tells them apart
    texts = [" ".join(many), " ".join(many), " ".join(near), "a short text of few words"]
    assert min(map(len, texts[:3])) > 1_800_000
    return texts, spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)],
                                        "doc_id long, text string, lang string, source string").cache()


def test_exact_copies_of_very_long_texts(long_texts):
    _, df = long_texts
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df).collect()}
    assert got == {0: (1, 2, False), 1: (1, 2, True), 2: (2, 1, True), 3: (3, 1, True)}


def test_near_copies_of_very_long_texts(long_texts):
    _, df = long_texts
    got = {r.doc_id: (r.rep_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == {0: (0, 0, True), 1: (0, 0, False), 2: (2, 0, False), 3: (3, 3, True)}


def test_tokens_words_and_scores_of_very_long_texts(long_texts):
    """Nothing is a prefix: the last words count in ids, word counts and scores."""
    texts, df = long_texts
    path = public_tokenizers.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encode_decode(df, path).collect()}
    for i in (0, 2, 3):
        ids = reference.encode(texts[i], add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].decoded == texts[i]
    mix = {r.doc_id: r.n_words for r in mixing.source_mix(df).collect()}
    assert mix == {0: 340_000, 1: 340_000, 2: 340_000, 3: 6}
    model = {"features": [(f, 100) for f in toxicity.word_features(b"zebra")][:1], "weights": np.array([5.0]), "bias": -2.0}
    scores = {r.doc_id: r.predicted for r in toxicity.score_toxicity(df, model=model).collect()}
    assert scores == {0: 0, 1: 0, 2: 1, 3: 0}
