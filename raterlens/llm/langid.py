"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows,
each filter's maximum over the window goes to a softmax layer. The network is
trained in numpy on the driver from a bounded sample of windows, then applied
to all windows of every whole text in batches; a document's probabilities are
those of its windows, weighted by their bytes.

A filter's response is a sum over its byte positions of a number that depends
on one byte only, so the trained filters are folded into tables of responses
by pairs of byte classes and evaluated by look-up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlens.llm.common import held_out

WINDOW = 256           # bytes of a window
WIDTHS = (2, 3, 4)     # bytes of the filters
FILTERS = 16           # filters of each width
EMBEDDING = 8
TRAIN_DOCS = 1500      # bound of the sample: documents of each language,
TRAIN_WINDOWS = 2      # and windows of each document
MAX_DOCS = 40_000      # and of all languages, but for one of each
EPOCHS = 6
BATCH = 64
LEARNING_RATE = 0.01
SEED = 11
STEP_BYTES = 1 << 18   # bytes of the windows evaluated together, a multiple of WINDOW
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")

# Byte classes: folded letters, all bytes from 0x80, and one class each for
# digits, white space, other ASCII and the padding after a text.
_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (_b - 128 + 30 if _b >= 128 else ord(_c.lower()) - 97 + 4 if _c.isalpha()
                  else 1 if _c.isdigit() else 2 if _c.isspace() else 3)
CLASSES = 158


def byte_windows(text: str | bytes) -> tuple[np.ndarray, np.ndarray]:
    """Windows of byte classes (padded with class 0) that tile the whole text,
    and their numbers of bytes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text, np.uint8)
    n = -(-len(raw) // WINDOW)
    out = np.zeros((n, WINDOW), np.int64)
    out.ravel()[:len(raw)] = _CLASS[raw]
    sizes = np.full(n, WINDOW)
    if n:
        sizes[-1] = len(raw) - WINDOW * (n - 1)
    return out, sizes


class ByteCNN:
    def __init__(self, labels: list[str], seed: int = SEED):
        r = np.random.default_rng(seed)
        self.labels = labels
        self.emb = r.normal(0, 0.5, (CLASSES, EMBEDDING))
        self.filters = [r.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS))
        self.out = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels)))
        self.out_bias = np.zeros(len(labels))

    def _parameters(self):
        return [self.emb, *self.filters, self.bias, self.out, self.out_bias]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ByteCNN:
        """Softmax cross-entropy, Adam; only the positions that hold a filter's
        maximum receive its gradient. Classes weigh equally."""
        r = np.random.default_rng(seed)
        weight = (len(y) / np.maximum(np.bincount(y, minlength=len(self.labels)), 1) / len(self.labels))[y]
        m = [np.zeros_like(p) for p in self._parameters()]
        v = [np.zeros_like(p) for p in self._parameters()]
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                at = order[lo:lo + BATCH]
                xb, n = x[at].astype(np.int64), len(at)
                rows = np.arange(n)[:, None]
                best, peak = [], []
                for w, f in zip(WIDTHS, self.filters):
                    table = np.einsum("ce,wef->wcf", self.emb, f)
                    resp = sum(table[k][xb[:, k:WINDOW - w + 1 + k]] for k in range(w))
                    peak.append(resp.argmax(1))
                    best.append(np.take_along_axis(resp, peak[-1][:, None], 1)[:, 0])
                pre = np.concatenate(best, 1) + self.bias
                hidden = np.maximum(pre, 0)
                logits = hidden @ self.out + self.out_bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), y[at]] -= 1
                p *= weight[at][:, None] / n
                back = (p @ self.out.T) * (pre > 0)
                g_emb = np.zeros_like(self.emb)
                g_filters = []
                for j, (w, f) in enumerate(zip(WIDTHS, self.filters)):
                    b = back[:, j * FILTERS:(j + 1) * FILTERS]
                    g = np.zeros_like(f)
                    for k in range(w):
                        c = xb[rows, peak[j] + k]
                        g[k] = np.einsum("nf,nfe->ef", b, self.emb[c])
                        np.add.at(g_emb, c.ravel(), (b[:, :, None] * f[k].T[None]).reshape(-1, EMBEDDING))
                    g_filters.append(g)
                grads = [g_emb, *g_filters, back.sum(0), hidden.T @ p, p.sum(0)]
                step += 1
                for q, g, a, b in zip(self._parameters(), grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= LEARNING_RATE * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
        return self

    def folded(self) -> dict:
        """Look-up tables for :func:`probabilities`: responses by class pairs,
        then by single classes for an odd last position."""
        tables = []
        for w, f in zip(WIDTHS, self.filters):
            one = np.einsum("ce,wef->wcf", self.emb, f).astype(np.float32)
            pairs = [(k, (one[k][:, None] + one[k + 1][None]).reshape(-1, FILTERS)) for k in range(0, w - 1, 2)]
            tables.append((w, pairs, one[w - 1] if w % 2 else None))
        return {"tables": tables, "bias": self.bias, "out": self.out, "out_bias": self.out_bias, "labels": self.labels}


def probabilities(net: dict, x: np.ndarray) -> np.ndarray:
    """Softmax of windows of byte classes (n x WINDOW)."""
    pair = x[:, :-1] * CLASSES + x[:, 1:]
    best = []
    for w, pairs, last in net["tables"]:
        n = WINDOW - w + 1
        resp = None
        for k, table in pairs:
            part = table[pair[:, k:k + n]]
            resp = part if resp is None else np.add(resp, part, out=resp)
        if last is not None:
            part = last[x[:, w - 1:w - 1 + n]]
            resp = part if resp is None else np.add(resp, part, out=resp)
        best.append(resp.max(1))
    logits = np.maximum(np.concatenate(best, 1) + net["bias"], 0) @ net["out"] + net["out_bias"]
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def classify(net: dict, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Label and score of whole texts; windows are evaluated in steps."""
    labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not net["labels"]:
        return labels, scores
    total = np.zeros((len(texts), len(net["labels"])))
    held, sizes, owner, n = [], [], [], 0

    def flush():
        np.add.at(total, np.concatenate(owner), probabilities(net, np.concatenate(held)) * np.concatenate(sizes)[:, None])

    known = []
    for i, t in enumerate(texts):
        if not t or not _LETTER.search(t):
            continue
        known.append(i)
        raw = t.encode("utf-8", "surrogatepass")
        for lo in range(0, len(raw), STEP_BYTES):  # whole windows, so the tiling is that of the text
            windows, size = byte_windows(raw[lo:lo + STEP_BYTES])
            held.append(windows)
            sizes.append(size)
            owner.append(np.full(len(held[-1]), i))
            n += held[-1].size
            if n >= STEP_BYTES:
                flush()
                held, sizes, owner, n = [], [], [], 0
    if held:
        flush()
    for i in known:
        p = total[i] / total[i].sum()
        k = int(p.argmax())
        labels[i], scores[i] = net["labels"][k], float(min(1.0, p[k]))
    return labels, scores


_SAMPLE = pa.schema([("lang", pa.string()), ("window", pa.binary())])


def _sample_windows(batches):
    """Some windows of each sampled text, spread evenly over its length."""
    for batch in batches:
        langs, out = [], []
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            windows, _ = byte_windows(text or "")
            for k in sorted({len(windows) * (2 * j + 1) // (2 * TRAIN_WINDOWS) for j in range(TRAIN_WINDOWS)}):
                if len(windows):
                    langs.append(lang)
                    out.append(windows[k].astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], schema=_SAMPLE)


def train(docs: DataFrame, docs_per_language: int = TRAIN_DOCS, seed: int = SEED) -> dict:
    """Fit the network on documents outside the held-out fold.

    The sample is bounded: ``docs_per_language`` documents of each language
    (the first in the order of a hash of the id), fewer where there are many
    languages: MAX_DOCS together, but at least one of each, so every label is
    learnt. TRAIN_WINDOWS windows of WINDOW bytes of each document reach the
    driver. The documents are chosen from ids and languages alone; only the
    chosen texts are read further.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("lang").cast("string").alias("l")) \
        .filter(F.col("l").isNotNull() & F.col("id").isNotNull() & ~held_out("id", 5, 0))
    languages = ids.select("l").distinct().count()
    docs_per_language = max(1, min(docs_per_language, MAX_DOCS // max(1, languages)))
    h = F.xxhash64("id", F.lit(seed))
    # first by salted parts, then by language: both limits are applied before the shuffle
    part = Window.partitionBy("l", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(64))).orderBy(h, "id")
    whole = Window.partitionBy("l").orderBy(h, "id")
    chosen = (ids.withColumn("n", F.row_number().over(part)).filter(F.col("n") <= docs_per_language)
              .withColumn("k", F.row_number().over(whole)).filter(F.col("k") <= docs_per_language))
    chosen = chosen.select(F.col("id").alias("__id"))  # bounded by the sample
    texts = docs.select(F.col("doc_id").cast("bigint").alias("__doc"), F.col("lang").cast("string").alias("lang"),
                        F.col("text").cast("string").alias("text")) \
        .join(F.broadcast(chosen), F.col("__doc") == F.col("__id"), "left_semi") \
        .filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    rows = texts.mapInArrow(_sample_windows, "lang string, window binary").toPandas()
    rows = rows.sort_values(["lang", "window"], ignore_index=True)
    labels = sorted(set(rows["lang"]))
    net = ByteCNN(labels, seed)
    if len(rows):
        x = np.frombuffer(b"".join(rows["window"]), np.uint8).reshape(-1, WINDOW)
        net.fit(x, rows["lang"].map({s: i for i, s in enumerate(labels)}).to_numpy(), seed=seed)
    return net.folded()


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(net):
    def run(batches):
        for batch in batches:
            labels, scores = classify(net.value, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                schema=_OUT)

    return run


def identify(docs: DataFrame, net: dict | None = None) -> DataFrame:
    """Language of every whole text.

    ``docs`` needs doc_id and text, and lang where ``net`` is not given
    (:func:`train` is called then); further columns are ignored. Returns a row
    for every input row: doc_id, held_out (crc32 of the id as text mod 5 is 0),
    lang_pred and score (0 to 1, the byte-weighted mean probability).

    A text that is null or has no letter is 'und' with score 0, and so is
    every text if there is nothing to learn from. Ties go to the first label
    in order. Null ids are not held out and are not learnt from; repeated rows
    get equal answers; an empty table gives no rows. All windows of a very long
    text are scored, STEP_BYTES at a time, so memory doesn't grow with them.
    """
    net = train(docs) if net is None else net
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed-size tables
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id", 5, 0).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(shared), "doc_id bigint, held_out boolean, lang_pred string, score double")
