"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased UTF-8 with every run of ASCII non-letters as one space; its subwords are all
byte n-grams of 2 to 4. Each subword hashes to a row of an embedding table, a text is the mean of
its rows, and a linear softmax turns it into languages. Training is stochastic gradient descent in
numpy on a bounded sample: at most ``SAMPLE`` labelled whole texts a fit, those of least hash, as
counts of their subwords. A tenth of the sample sets the temperature and, at ``KEEP`` of its
correct answers, the score under which an answer is not accepted.

Since the model is linear, embedding and softmax weights collapse into one table of a few floats a
subword; prediction gathers and sums them over whole texts.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and not accepted; rows
without a language are predicted but not learned from, and null ids are not held out; texts of any
length are read whole, with the same result in one run or many; equal texts get equal answers,
ties go to the first language by name; repeated rows are predicted each; columns but doc_id, text
and lang are not read, whatever their names; an empty table gives no row; if nothing can be
learned all is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, small_batches, text_of
from .textpass import add_columns

BUCKETS = 1 << 15
DIM = 16
ORDERS = (2, 3, 4)
SAMPLE = 2000
RUN_BYTES = 1 << 20
EPOCHS = 3
KEEP = 0.99
LETTER = re.compile(r"[^\W\d_]")
#: ASCII but for letters becomes a space, and capitals become small.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def subwords(a: np.ndarray, first: int = 0) -> np.ndarray:
    """Bucket of every n-gram of the bytes ``a`` that ends at ``first`` or later."""
    h = a.astype(np.uint32)
    out = []
    for k in range(2, max(ORDERS) + 1):
        if len(a) < k:
            break
        h = h[:-1] * np.uint32(0x01000193) + a[k - 1 :]
        if k in ORDERS:
            out.append(((h[max(0, first - k + 1) :] ^ np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(17))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def fold(text: str) -> np.ndarray:
    """Lower-cased bytes with a space at both ends, runs of spaces as one."""
    a = np.frombuffer(b" " + text.lower().encode().translate(FOLD) + b" ", np.uint8)
    return a[np.concatenate(([True], (a[1:] != 32) | (a[:-1] != 32)))]


def runs(text: str) -> Iterator[np.ndarray]:
    """The subwords of the text, in runs of bounded size."""
    a = fold(text)
    for at in range(0, len(a), RUN_BYTES):
        back = min(at, max(ORDERS) - 1)
        yield subwords(a[at - back : at + RUN_BYTES], back)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct subwords and their counts."""
    total = np.zeros(BUCKETS, np.int64)
    for g in runs(text):
        total += np.bincount(g, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def fit(grams: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 7) -> dict:
    """The model from each text's subwords and counts: languages, the collapsed table, bias, temperature and least accepted score."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    grams = [(g, (c / c.sum()).astype(np.float32)) for g, c in grams]
    held = np.arange(len(y)) % 10 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((len(names), DIM), np.float32), np.zeros(len(names), np.float32)
    train = np.flatnonzero(~held)
    for epoch in range(EPOCHS):
        rate = np.float32(0.5 * (1 - epoch / EPOCHS))
        for i in rng.permutation(train):
            g, share = grams[i]
            if not len(g):
                continue
            v = share @ emb[g]
            z = w @ v + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = w.T @ p
            w -= rate * np.outer(p, v)
            b -= rate * np.float32(0.1) * p
            emb[g] -= (rate * 10) * share[:, None] * back
    table = emb @ w.T
    logits = lambda g: g[1] @ table[g[0]] + b
    temperature, least = 1.0, 0.0
    check = [i for i in np.flatnonzero(held) if len(grams[i][0])]
    if check:
        z = np.array([logits(grams[i]) for i in check])
        t = y[check]

        def loss(k: float) -> float:
            s = z / k
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(t)), t]).mean())

        temperature = min((0.25 * 1.25**k for k in range(14)), key=loss)
        p = _softmax(z / temperature)
        right = p.argmax(1) == t
        if right.any():
            least = float(np.quantile(p.max(1)[right], 1 - KEEP))
    return {"names": names, "table": np.ascontiguousarray(table, np.float32), "bias": b, "temperature": temperature, "least": least}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def score_text(model: dict, text: str | None) -> tuple[str, float, bool]:
    """(language, score, accepted) of a whole text."""
    if text is None or not model["names"] or not LETTER.search(text):
        return "und", 0.0, False
    total, count = np.zeros(len(model["names"]), np.float64), 0
    for g in runs(text):
        total += np.bincount(g, minlength=BUCKETS) @ model["table"] if len(g) > BUCKETS else model["table"].take(g, axis=0).sum(0, dtype=np.float64)
        count += len(g)
    p = _softmax((total / max(count, 1) + model["bias"]) / model["temperature"])
    k = int(p.argmax())
    return model["names"][k], float(p[k]), bool(p[k] >= model["least"])


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> dict:
    """Fit on at most ``sample`` rows for which ``learn`` holds, taken by the hash of their text."""
    text = text_of(docs)
    rows = docs.where(learn & F.col("lang").isNotNull()).select(text.alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", text).alias("h"))
    chosen = bounded_sample(rows.select("h"), F.col("h"), sample, docs.count()).distinct()  # longs

    def make() -> Callable:
        def run(texts: list[str]) -> list[pa.Array]:
            found = [counted(t) for t in texts]
            return [pa.array([g.astype(np.uint16) for g, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.int32()))]

        return run

    got = add_columns(rows.join(F.broadcast(chosen), "h"), make, "g array<int>, c array<int>", keep=["h", "lang"]).orderBy("h", "lang").limit(sample).toArrow()
    if not got.num_rows:
        return {"names": []}
    columns = [[np.asarray(x.values) for x in got.column(k).combine_chunks()] for k in ("g", "c")]
    return fit(list(zip(*columns, strict=True)), got.column("lang").to_pylist())


def predict(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep`` columns with lang_pred, score and accepted of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # under 1 MB for a few languages
    kept = docs.select(*keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [score_text(held.value, t) for t in batch.column(len(keep)).to_pylist()]
            columns = [*batch.columns[: len(keep)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "accepted"])

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, f"{fields}, lang_pred string, score double, accepted boolean")


def identify_documents(docs: DataFrame) -> DataFrame:
    """The contract's rows: documents whose crc32 leaves 2 modulo 4 are held out of training."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = train(rows, ~F.col("held_out"))
    return predict(rows, model, ["doc_id", "held_out"])
