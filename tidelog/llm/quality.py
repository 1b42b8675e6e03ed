"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's features are hashed: its distinct words without case and outer punctuation, their
first four and five letters, the punctuation they carry, and coarse shares (capitals, symbols,
distinct words). All grades share
one weight vector; ordered thresholds cut its score, P(grade >= k) = sigmoid(score - threshold k).
Grades: 0 for poor quality, 1 for toxic, 2 for the rest. ``tail_prob`` is the chance of the
highest grade and selects; ``expected_grade`` is the sum of the tails.

The weights are fitted in numpy with Adam on at most ``SAMPLE`` rated documents, those of least
hashed id; features that no cut between grades sets apart by ``LEAST_Z`` standard errors of a full sample stay 0.
Every whole text is scored.

Edge cases: null or empty texts have only their share features and are graded by them; texts of any
length are read whole; ratings with null count as 0; repeated documents or ratings count each;
rows equal in text get equal grades, and ties at the cut are selected; a column of the documents
that has the name of a new one gives way to it in ``score`` and stays in ``select_documents``; an
empty table gives no row; without any rating every document is kept with probability 1 and grade 2.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, text_of, worker_cache
from .textpass import add_columns

BUCKETS = 1 << 20
SAMPLE = 12_000
LEAST_Z = 10.0
STEPS = 400
RATE = 0.1
RIDGE = 2e-5
CUT = 0.5
GRADES = 3
#: Words kept by a worker, and the longest of them: some 30 MB.
CACHE_WORDS, CACHE_CHARS = 100_000, 64
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) & (BUCKETS - 1)


class Chunks(dict):
    """Word with punctuation -> its feature buckets, of ``kept`` ones only if that is given."""

    def __init__(self, kept: set[int] | None = None):
        self.kept = kept

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        word = chunk.strip(PUNCTUATION)
        found = []
        if word:
            low = word.lower()
            found = [_bucket("w " + low), _bucket("4 " + low[:4]), _bucket("5 " + low[:5])]
        if word != chunk:
            found.append(_bucket("p " + chunk.replace(word, " ", 1) if word else "p " + chunk))
        value = tuple(f for f in found if self.kept is None or f in self.kept)
        if len(self) < CACHE_WORDS and len(chunk) <= CACHE_CHARS:  # the first words met stay
            self[chunk] = value
        return value


def shares(text: str, chunks: list[str], distinct: int) -> list[int]:
    """Buckets of the coarse shares, in eighths."""
    n = max(len(chunks), 1)
    made = {"capitals": sum(map(str.isupper, chunks)) / n, "symbols": min(sum(map(text.count, "*#$%&|!")) / n, 1), "distinct": distinct / n, "lines": min(text.count("\n") * 20 / max(len(text), 1), 1)}
    return [_bucket(f"s {k} {int(v * 8 + 1e-9)}") for k, v in made.items()]


def features(text: str, table: Chunks) -> np.ndarray:
    chunks = text.split()
    distinct = set(chunks)
    found = set().union(*filter(None, map(table.__getitem__, distinct)))
    found.update(shares(text, chunks, len(distinct)))
    return np.array(sorted(found), np.int32)


def telling(rows: list[np.ndarray], grades: np.ndarray) -> np.ndarray:
    """Whether each bucket's frequency differs between the documents above and below a cut of the grades."""
    kept = np.zeros(BUCKETS, bool)
    for k in range(1, GRADES):
        n, df = np.zeros(2), np.zeros((2, BUCKETS))
        for r, y in zip(rows, grades, strict=True):
            n[int(y >= k)] += 1
            df[int(y >= k), r] += 1
        if n.all():
            p = df.sum(0) / n.sum()
            least = max(4.0, LEAST_Z * np.sqrt(n.sum() / SAMPLE))  # errors shrink with the sample, so this asks the same effect of any
            kept |= np.abs(df[1] / n[1] - df[0] / n[0]) > least * np.sqrt(p * (1 - p) * (1 / n).sum())
    return kept


def fit(rows: list[np.ndarray], grades: np.ndarray) -> dict:
    """Weights and thresholds that maximise the ordinal likelihood."""
    kept = telling(rows, grades)
    rows = [r[kept[r]] for r in rows]
    lengths = np.array([len(r) for r in rows])
    column, row = np.concatenate([*rows, np.zeros(0, np.int32)]), np.repeat(np.arange(len(rows)), lengths)
    names, column = np.unique(column, return_inverse=True)
    grades = np.asarray(grades)
    counts = np.bincount(grades, minlength=GRADES) + 1.0
    tail = np.cumsum(counts[::-1])[::-1] / counts.sum()
    each = np.sqrt(counts.sum() / (GRADES * counts))[grades] / len(grades)  # rarer grades weigh more, by the root
    x = np.concatenate((np.zeros(len(names)), -np.log(tail[1:] / (1 - tail[1:]))))  # weights, then thresholds
    first, second = np.zeros_like(x), np.zeros_like(x)
    one = np.ones(len(grades))
    at = np.arange(len(grades))
    for t in range(1, STEPS + 1):  # Adam on the whole sample
        w, theta = x[: len(names)], x[len(names) :]
        score = np.bincount(row, w[column], minlength=len(grades))
        s = np.column_stack((one, 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -30, 30))), 0 * one))  # P(grade >= k)
        up, down = s[at, grades], s[at, grades + 1]
        gap = np.maximum(up - down, 1e-9)
        by_score = each * (1 - up - down)  # derivative of log P(grade) by the score
        by_theta = np.array([(each * ((grades == k + 1) * -1.0 + (grades == k)) * s[:, k + 1] * (1 - s[:, k + 1]) / gap).sum() for k in range(GRADES - 1)])
        g = np.concatenate((np.bincount(column, by_score[row], minlength=len(names)) - RIDGE * w, by_theta))
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        x = x + RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        x[len(names) :] = np.maximum.accumulate(x[len(names) :])
    w, theta = x[: len(names)], x[len(names) :]
    return {"at": names.astype(np.int32), "w": w.astype(np.float32), "theta": theta}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Fit on at most ``sample`` rated documents; None if there are none."""
    grade = F.when(F.coalesce(F.col("quality"), F.lit(0)) < 1, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) >= 1, 1).otherwise(2)
    rated = bounded_sample(labels.where("doc_id is not null").select("doc_id", grade.alias("grade")), F.xxhash64("doc_id", "grade"), sample, labels.count())
    # at most `sample` rows of 12 bytes
    joined = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(rated), "doc_id")

    def make() -> Callable:
        table = worker_cache("chunks", Chunks)
        return lambda texts: [pa.array([features(t, table) for t in texts], pa.list_(pa.int32()))]

    got = add_columns(joined, make, "features array<int>", keep=["grade", "doc_id"]).orderBy("doc_id", "grade").limit(sample).toArrow()
    if not got.num_rows:
        return None
    return fit([np.asarray(x.values) for x in got.column("features").combine_chunks()], got.column("grade").to_numpy())


def score(docs: DataFrame, model: dict | None, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Documents with expected_grade, tail_prob and selected."""
    if model is None:
        return docs.select(*(keep or docs.columns)).withColumns({"expected_grade": F.lit(GRADES - 1.0), "tail_prob": F.lit(1.0), "selected": F.lit(True)})
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights at most: 8 MB
    name = f"chunks {uuid.uuid4().hex}"

    def make() -> Callable:
        m = held.value
        weights = np.zeros(BUCKETS, np.float32)
        weights[m["at"]] = m["w"]
        table, theta = worker_cache(name, lambda: Chunks(set(m["at"].tolist()))), m["theta"]

        def run(texts: list[str]) -> list[pa.Array]:
            total = np.array([weights[features(t, table)].sum() for t in texts], np.float64)
            tails = 1 / (1 + np.exp(-np.clip(total[:, None] - theta, -30, 30)))
            return [pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= CUT)]

        return run

    return add_columns(docs, make, "expected_grade double, tail_prob double, selected boolean", text=text, keep=keep)


def classify_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, tail_prob and selected of every document."""
    return score(docs, train(docs, labels), keep=["doc_id"])


def select_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier selects, with their columns as they were."""
    renamed = docs.withColumnsRenamed({c: f"d_{c}" for c in docs.columns})  # the score's names may be taken
    flag = score(renamed, train(docs, labels), text="d_text")
    return flag.where("selected").select(*[F.col(f"d_{c}").alias(c) for c in docs.columns])
