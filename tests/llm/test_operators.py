"""The training-data operators against brute force, exact round trips,
held-out rows and defined results on odd input."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from raterlens.llm import (bpe, exact_dedup, html_extract, langid, licenses, minhash, mixing, pii, toxicity,
                           vec_dedup)
from raterlens.llm.common import ascii_words, components

DOCS = "doc_id long, text string, lang string, source string, score double, kept string, id long, key string"
LONG = "Lorem ipsum dolor sit amet, " * 6000


def frame(spark, rows, schema=DOCS):
    """Rows (doc_id, text, lang, source) with extra columns whose names the
    operators use themselves."""
    return spark.createDataFrame([(a, b, c, d, 0.5, "x", 7, "k") for a, b, c, d in rows], schema)


ODD = [(1, None, None, None), (2, "", "en", ""), (3, "!!! ???", "en", "a"), (4, "one two", "en", "a"),
       (4, "one two", "en", "a"), (5, "One TWO", "en", "b"), (None, "no id here", "en", "b"),
       (6, LONG, "la", "c"), (7, LONG.upper(), "la", "c"), (8, "Ünïcode ÀÉ ß 日本 🤔", "xx", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def documents(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")


# -- exact copies


def test_golomb_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 3000):
        for top in (3, 900, 2 ** 48):
            v = np.unique(rng.integers(0, top, n, dtype=np.uint64))
            assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(v)) == v).all()


def exact_brute(rows):
    norm = [(i, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t, *_ in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return Counter(out)


def test_exact_duplicates(spark, odd, empty, documents):
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = Counter(tuple(r) for r in exact_dedup.exact_duplicates(odd).select(cols).collect())
    assert got == exact_brute(ODD)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    # few fingerprint bits: many false suspects, the same answer
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in exact_dedup.exact_duplicates(documents, fingerprint_bits=33).select(cols).collect())
    assert got == exact_brute(rows)


def test_hot_group_sends_one_code_word_a_chunk(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}", "en", "s") for i in range(3000)]
    out = exact_dedup.exact_duplicates(frame(spark, rows).repartition(7))
    assert out.filter("group_size = 2000").count() == 2000 and out.filter("kept").count() == 1001


# -- byte-level BPE


def test_bpe_equals_the_library(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [*ODD, (20, "a<|endoftext|> <|endoftext|>b", "en", "s"), (21, "a" * 5000, "en", "s"),
            (22, " x \n\n  y's\t12 345½ ", "en", "s"), (23, "x²³ ١٢ don't we'll  ", "en", "s")]
    got = {r.doc_id: r for r in bpe.encode_decode(frame(spark, rows), path).collect()}
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert got[i].n_tokens == len(ids)
        assert got[i].decoded == lib.decode(ids, skip_special_tokens=False) == (t or "")
    digest = {r.doc_id: r for r in bpe.encode_digests(frame(spark, rows), path).collect()}
    for i, r in got.items():
        assert digest[i].ids_sha256 == hashlib.sha256(r.ids).hexdigest()
        assert digest[i].decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_decode(empty, path).count() == 0


def test_bpe_on_random_words():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bpe.Encoder(bpe.Vocabulary(path))
    rng = np.random.default_rng(3)
    letters = list("aaaabtheinor  éß日🤔'.0")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(800)]
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want
    assert [own.decode(c) for c in want] == texts


# -- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><p>Site header with quite some words in it</p></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies for all the things you know and love.</p></div>
<aside class="sidebar">Popular things of the week for every reader out there</aside>%s
<form><p>Sign up for our letter today, it is free of charge</p></form><footer>&copy; 2024</footer></body></html>"""


def test_main_text_leaves_boilerplate():
    body = ("<article><h1>A &amp; B</h1><p>First   paragraph with<br>some <b>bold</b> words &eacute;.<p>Second one, "
            "rather long and full of plain words that make it content.</p><div class='ad'>Buy now, buy a lot of this "
            "thing today</div><p>No.</p><section class='comments'><p>I am a reader with a long comment about it.</p>"
            "</section></article>")
    want = ("A & B\n\nFirst paragraph with some bold words é.\n\nSecond one, rather long and full of plain words that "
            "make it content.\n\nNo.")
    assert html_extract.main_text(PAGE % body) == want
    assert html_extract.main_text(PAGE % body.replace("article", "div")) == want
    cut = PAGE.split("%s")[0] + body.replace("</article>", "")
    assert html_extract.main_text(cut) == want


def test_pages(spark, sf_small):
    schema = "page_id long, url string, html string, text string"
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "plain words", "x"),
                                 (None, "u", "<p>a<![CDATA[x]]>b<", "x"), (3, "u", "plain words", "x")], schema)
    got = {(r.page_id, r.text, r.n_chars) for r in html_extract.extract_pages(odd).collect()}
    assert {(1, "", 0), (2, "", 0), (3, "plain words", 11)} <= got
    assert html_extract.extract_pages(odd).count() == 5
    assert html_extract.extract_pages(odd.limit(0)).count() == 0
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    import html as h
    for r in html_extract.extract_pages(pages).collect():
        article = re.search("<article>(.*?)</article>", html[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(h.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# -- licences


def test_licence_places_and_statistics_against_brute_force():
    sam = licenses.Automaton(licenses.TEMPLATES, licenses.PHRASES)
    rng = np.random.default_rng(2)
    pool = [*list(sam.vocab)[:30], b"mit", b"license", b"apache", b"general", b"public", b"zz"]
    runs = [*sam.words, *(list(p) for p, _ in sam.phrases)]
    parts = {tuple(r[i:j]) for r in runs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    for _ in range(300):
        words = [pool[k] for k in rng.integers(0, len(pool), rng.integers(0, 40))]
        want = sorted((i, k) for k, (p, _) in enumerate(sam.phrases) for i in range(len(words))
                      if tuple(words[i:i + len(p)]) == p)
        cut = int(rng.integers(0, 41))  # steps go on where the one before ended
        steps = [words[:cut], words[cut:]]
        assert sorted(sam.scan(steps)[0]) == want
        longest = {}
        for i in range(len(words)):
            n = max((n for n in range(1, i + 2) if tuple(words[i - n + 1:i + 1]) in parts), default=0)
            if n >= 2:
                longest[i] = n
        assert {i: n for i, _, n in sam.statistics(steps)} == longest


def test_licence_scan(spark, odd, empty):
    rows = [(1, "Released under the MIT License. mit-license x MIT  LICENSE", "en", "s"),
            (2, "the GNU General Public License, version 3", "en", "s"), (3, "Licensed under CC BY-NC 4.0.", "en", "s"),
            (4, "general public licenses mit", "en", "s"),
            (5, "Permission is hereby granted, free of charge, to XX any person obtaining a copy of this software "
                "and associated documentation files", "en", "s")]
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word) == (10, 3, 3, 8)
    assert got[1].base_labels == got[1].labels == "mit" and got[1].score == 1.0
    assert got[2].base_labels == "gpl" and got[2].n_base == 1
    assert got[3].base_labels == "" and got[3].labels == "cc-by-nc" and got[3].first_word is None
    assert (got[4].labels, got[4].n_base) == ("", 0)
    assert got[5].labels == "mit" and 0.6 <= got[5].score < 1
    out = licenses.license_scan(odd)
    assert out.count() == len(ODD) and out.filter("doc_id = 1 AND n_words = 0 AND labels = ''").count() == 1
    assert licenses.license_scan(empty).count() == 0


def test_chain_needs_template_order():
    sam = licenses.Automaton([("x", "a b c d e f g h")], licenses.PHRASES)
    assert sam.scan([ascii_words("a b c z e f g h")])[1] == {0: [(0, 2, 0), (4, 7, 4)]}
    assert sam.scan([ascii_words("e f g h z a b c")])[1] == {0: [(4, 7, 0)]}


# -- pseudonyms


VALUES = ("mail rhokk.73@mail2.example.com call +1 (988) 555-2485 or 988-555-2485 card 4111 1111 1111 1111 bad "
          "4111111111111112 born 1988-05-23 or 23.05.1988 bad 2023-02-30 ip 70.214.118.188 v 4.0. 300.1.1.1 ssn "
          "123-45-6789 bad 000-12-1234 iban DE89 3704 0044 0532 0130 00")


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark, empty):
    rows = [(1, VALUES, "en", "s"), (2, "again 4111111111111111, RHOKK.73@other.example.org 05/23/1988", "en", "s"),
            (3, None, "en", "s"), (4, "", "en", "s"), (None, "nothing 12", "en", "s")]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, rows)).collect()}
    a, b = got[1].text, got[2].text
    assert re.sub("[0-9A-Za-z]+", "x", a) == re.sub("[0-9A-Za-z]+", "x", VALUES)
    assert got[1].n_values == 9 and got[1].kinds == "card,date,email,iban,ip,phone,ssn"
    for kept in ("bad 4111111111111112", "bad 2023-02-30", "300.1.1.1", "000-12-1234", "v 4.0."):
        assert kept in a
    for gone in ("rhokk", "555-2485", "4111 1111 1111 1111", "1988", "70.214.118.188", "123-45-6789", "3704 0044"):
        assert gone not in a
    card = re.search(r"card ([\d ]{19})", a)[1]
    assert luhn(card) and card.replace(" ", "") in b
    assert re.search(r"mail (\S+)@", a)[1] + "@other.example.org" in b
    day = re.search(r"born (\d+)-(\d+)-(\d+)", a).groups()
    assert f"{day[2]}.{day[1]}.{day[0]}" in a and f"{day[1]}/{day[2]}/{day[0]}" in b
    iban = re.search(r"iban (.*)", a)[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert (got[3].text, got[3].n_values, got[4].text, got[None].text) == (None, 0, "", "nothing 12")
    assert pii.pseudonymise(empty).count() == 0
    other = pii.pseudonymise(frame(spark, rows), key="other").filter("doc_id = 1").first().text
    assert other != a


def test_pseudonyms_are_a_bijection_and_match_a_plain_version(spark):
    import datetime
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(days=37 * i) for i in range(1900)]
    rows = [(i, f"on {d.isoformat()} from 10.{i % 256}.{i // 256}.9", "en", "s") for i, d in enumerate(days)]
    got = {r.doc_id: r.text for r in pii.pseudonymise(frame(spark, rows)).collect()}
    assert len({t.split()[1] for t in got.values()}) == len({t.split()[3] for t in got.values()}) == len(rows)

    def permuted(vec, radix, tweak):
        for r in range(1, pii.ROUNDS + 1):
            other = ",".join(str(w) for j, w in enumerate(vec) if j % 2 != r % 2)
            vec = [(v + int(hashlib.sha256(f"{pii.KEY}|{tweak}|{r}|{i}|{other}".encode()).hexdigest()[:13], 16)) % radix[i]
                   if i % 2 == r % 2 else v for i, v in enumerate(vec)]
        return vec

    for i, d in list(enumerate(days))[::97]:
        n = (d - datetime.date(1900, 1, 1)).days
        a, b = permuted([n // pii.DAY_B, n % pii.DAY_B], [pii.DAY_A, pii.DAY_B], "date")
        day = datetime.date(1900, 1, 1) + datetime.timedelta(days=a * pii.DAY_B + b)
        ip = ".".join(map(str, permuted([10, i % 256, i // 256, 9], [256] * 4, "ip")))
        assert got[i] == f"on {day.isoformat()} from {ip}"


def test_pseudonyms_leave_other_text(spark, documents):
    j = pii.pseudonymise(documents).join(documents.select("doc_id", F.col("text").alias("was")), "doc_id")
    assert j.filter("n_values = 0 AND text <> was").count() == 0
    assert j.filter("length(text) <> length(was) AND NOT kinds LIKE '%ip%'").count() == 0


# -- mixing


def test_mix_meets_entropy_and_repetition(spark, odd, empty):
    rows = [(i, " ".join(["w"] * 10), "en", "big" if i < 900 else f"s{i % 4}") for i in range(1000)]
    out = mixing.source_mix(frame(spark, rows), target_entropy=0.9, max_repeat=50.0)
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.col("n_words") * F.col("copies")).alias("n")).collect()}
    p = np.array(list(words.values())) / sum(words.values())
    assert -(p * np.log(p)).sum() / np.log(5) == pytest.approx(0.9, abs=0.01)
    assert sum(words.values()) == pytest.approx(10_000, rel=0.01)
    out = mixing.source_mix(frame(spark, rows), target_entropy=1.0, max_repeat=3.0)
    top = out.filter("source <> 'big'").agg(F.sum(F.col("n_words") * F.col("copies")) / F.sum("n_words")).first()[0]
    assert top <= 3.0 + 1e-9 and out.agg(F.max("copies")).first()[0] == 3
    whole = mixing.source_mix(frame(spark, rows), target_entropy=0.0)
    assert whole.filter("copies = 1").count() == 1000  # natural shares and budget: each document once
    got = mixing.source_mix(odd)
    assert got.count() == len(ODD) and got.filter("copies IS NULL OR weight IS NULL").count() == 0
    assert mixing.source_mix(empty).count() == 0


# -- language


def test_language_on_held_out_rows(spark, documents, odd, empty):
    out = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out")
    n = out.count()
    assert n and out.filter("lang = lang_pred").count() >= 0.9 * n
    assert out.filter("score < 0 OR score > 1").count() == 0
    got = langid.identify(odd).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 3))
    assert langid.identify(empty).count() == 0


def test_folded_tables_equal_the_network():
    net = langid.ByteCNN(["a", "b", "c"], 4)
    x = np.random.default_rng(0).integers(0, langid.CLASSES, (5, langid.WINDOW))
    peaks = []
    for w, f in zip(langid.WIDTHS, net.filters):
        e = net.emb[x]
        peaks.append(np.max([sum(e[:, i + k] @ f[k] for k in range(w)) for i in range(langid.WINDOW - w + 1)], 0))
    z = np.maximum(np.concatenate(peaks, 1) + net.bias, 0) @ net.out + net.out_bias
    want = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert np.allclose(langid.probabilities(net.folded(), x), want, atol=1e-5)


def test_whole_texts_are_read():
    net = langid.ByteCNN(["a", "b"], 1).folded()
    text = "abc " * 100_000
    windows, sizes = langid.byte_windows(text)
    p = langid.probabilities(net, windows[:1])[0]
    assert sizes.sum() == len(text)
    label, score = langid.classify(net, [text])
    assert score[0] == pytest.approx(p.max(), abs=1e-3) and label[0] == "ab"[int(p.argmax())]


# -- toxicity


def toxic_rows(n=1200):
    rng = np.random.default_rng(9)
    common, bad = [f"w{i}" for i in range(300)], ["vileone", "vileness", "vilety", "gruesome"]
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(common, rng.integers(5, 60)))
        toxic = int(rng.random() < 0.15)
        if toxic:
            words[1:1] = list(rng.choice(bad, 3))
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, toxic))
    return docs, labels


def test_toxicity_on_held_out_rows(spark, odd, empty):
    docs, labels = toxic_rows()
    d, lab = frame(spark, docs), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(d, lab)
    out = toxicity.score_toxicity(d, model=model).filter("held_out").collect()
    truth = dict(labels)
    right = [r.predicted == truth[r.doc_id] for r in out]
    assert len(out) > 300 and np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    got = toxicity.score_toxicity(odd, model=model)
    assert got.count() == len(ODD) and got.filter("predicted = 1").count() == 0
    assert toxicity.score_toxicity(empty, lab.limit(0)).count() == 0
    assert toxicity.score_toxicity(odd, lab.limit(0)).filter("score IS NULL").count() == 0


def test_risk_stays_non_negative_when_positives_fit_exactly():
    rng = np.random.default_rng(0)
    x_p, x_u = np.ones((20, 3), np.float32), (rng.random((200, 3)) < 0.02).astype(np.float32)
    w, b = toxicity.nnpu_fit(x_p, x_u, 0.3)
    assert np.isfinite(w).all() and (w >= 0).all()
    assert 1 / (1 + np.exp(-(w.sum() + b))) > 0.7


# -- near copies


def near_brute(rows, threshold=0.8):
    bags = {i: minhash.shingle_counts(ascii_words(t)) for i, t in rows}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if bags[a] and minhash.similarity(bags[a], bags[b]) >= threshold:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(20):
        base = rng.integers(0, 2 ** 62, 150, dtype=np.uint64)
        one = rng.choice([1, 1, 2, 3, 7, 40], 150)
        two = np.where(rng.random(150) < 0.7, one, rng.choice([0, 1, 5, 60], 150))
        has = two > 0
        sig = minhash.bag_signatures(np.r_[np.zeros(150, int), np.ones(has.sum(), int)], np.r_[base, base[has]],
                                     np.r_[one, two[has]], 2, 600)
        errors.append((sig[0] == sig[1]).mean() - np.minimum(one, two).sum() / np.maximum(one, two).sum())
    assert abs(np.mean(errors)) < 0.015


def test_near_duplicates_against_brute_force(spark, odd, empty):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(25):
        base = [f"t{x}" for x in rng.integers(0, 400, 80)]
        for _ in range(rng.integers(1, 6)):
            words = list(base)
            for at in rng.integers(0, 80, rng.integers(0, 4)):
                words[at] = f"t{rng.integers(0, 400)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, "la la " * n) for k, n in enumerate((30, 31, 60, 200))]
    rows += [(len(rows), "x y"), (len(rows) + 1, "X, y!"), (len(rows) + 2, ""), (len(rows) + 3, None)]
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    want = near_brute(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r.component_size == sizes[r.component_id] and r.kept == (r.doc_id == r.component_id) for r in got.values())
    out = minhash.near_duplicates(odd).collect()
    assert len(out) == len({r[0] for r in ODD if r[0] is not None})
    assert {r.doc_id: r.component_id for r in out} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8}
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_dense_group_about_the_threshold(spark, monkeypatch):
    """Many copies of one text, each edited on its own: some pairs link, most
    don't, so stars alone would miss links. Small blocks make many of them."""
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 16)
    rng = np.random.default_rng(8)
    base = [f"t{x}" for x in rng.integers(0, 4000, 150)]
    rows = []
    for _ in range(90):
        words = list(base)
        for at in rng.integers(0, 150, rng.integers(1, 7)):
            words[at] = f"u{rng.integers(0, 10 ** 9)}"
        rows.append((len(rows) + 5, " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(
        frame(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    want = near_brute(rows)
    assert len(set(want.values())) > 1 and got == want


def test_components_of_chains_and_cliques(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(3, 9), (9, 5), (7, 9)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 9: 3, 5: 3, 7: 3}


# -- embeddings


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = [rng.normal(size=16) for _ in range(300)]
    for k in range(0, 100, 5):
        x += [x[k] * rng.uniform(0.5, 2) + rng.normal(size=16) * 0.08 for _ in range(4)]
    x += [x[0] + rng.normal(size=16) * 0.02 for _ in range(600)] + [x[1]] * 50  # a clique beyond any list, and copies
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1),
             (n + 4, [1.0] * 15 + [None], 1), (n + 5, [float("inf")] * 16, 1), (n + 6, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, mult int")
    got = {r.vec_id: r for r in vec_dedup.embedding_duplicates(df).collect()}
    v = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    near = v @ v.T >= 0.95
    comp = np.arange(n)
    while True:
        new = np.array([comp[row].min() for row in near])
        if (new == comp).all():
            break
        comp = new
    found = np.array([got[i].n_links for i in range(n)])
    assert found.sum() >= 0.99 * (near.sum() - n) and (found <= near.sum(1) - 1).all()
    assert np.mean([got[i].component_id == comp[i] for i in range(n)]) > 0.99
    for i in range(n, n + 7):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert vec_dedup.embedding_duplicates(df.limit(0)).count() == 0


def linked(x, threshold=0.95):
    """Links of every vector and its component, by brute force."""
    v = x / np.linalg.norm(x, axis=1)[:, None]
    near = v @ v.T >= threshold
    comp = np.arange(len(x))
    while True:
        new = np.array([comp[row].min() for row in near])
        if (new == comp).all():
            return near.sum(1) - 1, comp
        comp = new


def vector_frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_embedding_pairs_beside_a_clique(spark, monkeypatch):
    """Each linked vector counts the same: a clique holds nearly all links, the
    pairs nearly all of the other linked vectors. Small blocks stand for a big
    table."""
    monkeypatch.setattr(vec_dedup, "BLOCK", 16)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1800, 48))
    pairs = x[:700] + rng.normal(size=(700, 48)) * 0.3
    clique = x[-1] + rng.normal(size=(600, 48)) * 0.02
    x = np.concatenate([x, pairs, clique])
    n_links, comp = linked(x)
    got = {r.vec_id: r for r in vec_dedup.embedding_duplicates(vector_frame(spark, x)).collect()}
    has = n_links > 0
    found = np.array([got[i].n_links for i in range(len(x))])
    assert has[:700].sum() > 300 and (found[has] / n_links[has])[~(n_links[has] > 500)].mean() >= 0.99
    assert np.mean([got[i].component_id == comp[i] for i in np.flatnonzero(has)]) >= 0.99


def test_embedding_links_are_whole_if_the_descent_finds_few(spark, monkeypatch):
    """The audit notices, and all vectors are compared exactly."""
    lost = spark.createDataFrame([(0, i) for i in range(1, 40)], "u long, w long")
    none = spark.createDataFrame([], "id long, code long")
    descents = []
    monkeypatch.setattr(vec_dedup, "_descend", lambda *a: descents.append(a) or (lost, none))
    monkeypatch.setattr(vec_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = np.concatenate([np.ones(16) + rng.normal(size=(40, 16)) * 0.02, *(
        v + rng.normal(size=(2, 16)) * 0.02 for v in rng.normal(size=(30, 16)))])
    n_links, comp = linked(x)
    got = {r.vec_id: r for r in vec_dedup.embedding_duplicates(vector_frame(spark, x)).collect()}
    assert len(descents) == vec_dedup.AUDIT_TRIES
    assert [got[i].n_links for i in range(len(x))] == n_links.tolist()
    assert [got[i].component_id for i in range(len(x))] == list(comp)


def test_audit_measures_sparse_links(spark, monkeypatch):
    """Twenty pairs among many vectors are still found missing, whatever the seed."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 32))
    x[-20:] = x[:20] + rng.normal(size=(20, 32)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").cache()
    for seed in (1, 2, 3):
        monkeypatch.setattr(vec_dedup, "SEED", seed)
        assert vec_dedup._recall(vecs, vecs, None, 0.95)[0] == 0.0
    found = spark.createDataFrame([(i, 1) for i in [*range(20), *range(5980, 6000)]], "u long, vectors long")
    assert vec_dedup._recall(vecs, vecs, found, 0.95) == (1.0, 40)


def test_embedding_links_between_dense_groups(spark):
    """Two groups, too large for any list, joined only by links just above the
    threshold."""
    rng = np.random.default_rng(5)
    a, b = np.zeros(32), np.zeros(32)
    a[0], b[:2] = 1, (0.9455, np.sqrt(1 - 0.9455 ** 2))
    x = np.concatenate([a + rng.normal(size=(500, 32)) * 0.004, b + rng.normal(size=(500, 32)) * 0.004])
    n_links, comp = linked(x)
    across = n_links - 499
    assert (comp == 0).all() and 0 < across.sum() < 5000
    got = {r.vec_id: r for r in vec_dedup.embedding_duplicates(vector_frame(spark, x)).collect()}
    assert [got[i].component_id for i in range(1000)] == [0] * 1000
    assert [got[i].n_links for i in range(1000)] == n_links.tolist()


def test_numbers_and_words_beside_cards_and_accounts(spark):
    card, other = "4111 1111 1111 1111", "5500-0000-0000-0004"
    cards = [f"{card} 12/27", f"{card} 123", f"2 {card}", f"1234 {card}", f"99 {card} 12/27 77", f"{card} {card} 55",
             f"{card} 05/23/1988", f"{card} 10.20.30.40", f"{card} 988-555-2485", f"{card} {other}", f"77 {other}-123",
             f"{card}/123", f"no {card} 7@example.org", f"{card} 2x"]
    ibans = ["PL61 1090 1014 0000 0712 1981 2874", "AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00",
             "DE89370400440532013000", "NO93 8601 1117 947"]
    rows = cards + [f"{i} {w}" for i in ibans for w in ("BIC", "IBAN", "AND THEN", "for", card)]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, [(k, t, "en", "s") for k, t in enumerate(rows)])).collect()}
    for k, t in enumerate(rows):
        assert card not in got[k].text and other not in got[k].text and not any(i in got[k].text for i in ibans), t
        assert re.sub("[0-9A-Za-z]", "x", got[k].text) == re.sub("[0-9A-Za-z]", "x", t) or "ip" in got[k].kinds
        assert got[k].n_values == len(got[k].spans) > 0 and all(v.new in got[k].text for v in got[k].spans)
    assert [got[k].kinds for k in (6, 7, 8, 9)] == ["card,date", "card,ip", "card,phone", "card"]
    assert [got[k].n_values for k in (0, 1, 2, 3, 5, 9)] == [1, 1, 1, 1, 2, 2]
    new = got[0].text[:19]
    assert got[0].text == f"{new} 12/27" and got[2].text == f"2 {new}" and got[3].text == f"1234 {new}" and luhn(new)
    assert got[len(cards)].text.endswith(" BIC") and got[len(cards) + 4].text.endswith(new)


STORY = ["A plain title", *(f"Paragraph {i} of the story, long enough and full of plain words to be read as content of it."
                            for i in range(6))]


def story(*blocks):
    return "".join(f"<{'h1' if b == STORY[0] else 'p'}>{b}</{'h1' if b == STORY[0] else 'p'}>" for b in blocks)


@pytest.mark.parametrize("mark", ["class='page has-sidebar'", "class='content-with-sidebar'", "class='share-enabled'",
                                  "id='social-policy'", "class='post comments-open'"])
def test_words_of_a_wrapper_exclude_no_article(mark):
    want = "\n\n".join(STORY)
    side = "<div class='related'><p>Read this other thing too, and that one, dear reader of pages.</p></div>"
    for tag in ("article", "main", "div"):
        body = f"<div {mark}><{tag}>{story(*STORY)}</{tag}>{side}</div>"
        assert html_extract.main_text(PAGE % body) == want


def test_region_holds_the_whole_story():
    want = "\n\n".join(STORY)
    teaser = "<article><p>Another story of the week, read it now or later.</p></article>"
    inner = story(*STORY[:3]), story(*STORY[3:])
    for body in ("<div id='content'>%s<section>%s</section></div>" % inner,
                 "<div>%s<blockquote>%s</blockquote></div>" % inner,
                 "<article>%s</article><article>%s</article>" % inner,
                 "<div><article>%s</article><div></div><div><article>%s</article></div></div>" % inner,
                 "<main>%s<article>%s</article></main>" % inner,
                 "<div>%s<div>%s</div></div>" % (story(STORY[0]), story(*STORY[1:])),
                 "<main>%s<article>%s</article></main>" % (story(STORY[0]), story(*STORY[1:])),
                 "<main><div>%s</div><div>%s</div></main>" % inner):
        assert html_extract.main_text(PAGE % body) == want, body
    for body in (f"<main>{story(*STORY)}</main>{teaser}", f"<div>{story(*STORY)}</div>{teaser}"):
        assert html_extract.main_text(PAGE % body).startswith(want), body


def test_main_text_reads_behind_many_comment_starts():
    """More than a hundred comments, ended by '-- >', once cut the page at the first."""
    body = f"<article><p>{'The first paragraph. ' * 10}</p>{'<!-- note -- >' * 101}<p>{'The last one. ' * 10}</p></article>"
    assert html_extract.main_text(PAGE % body).endswith("The last one.")
