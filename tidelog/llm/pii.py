"""Personal data: exact base patterns, and a skip-chain conditional random field that adds to them.

``base_spans`` finds e-mail addresses, IPs, card and phone numbers by fixed patterns. The field's
variables are a text's words with a digit or an at sign; their labels are none, the four kinds, and
secret (a key or token, which has no base pattern). A word has features of its shape and
neighbours; words that stand side by side share a transition potential, and words of equal text or
equal last digits, however far apart, share a skip potential (each with the one before it, so the
edges grow with the words). Loopy sum-product passes give each word's marginals, with the words of
base spans held at their kinds; words that reach ``SURE`` for a kind and touch no base span become
spans, neighbours of a kind together.

Weights are fitted by pseudo-likelihood in numpy on at most ``SAMPLE`` whole texts. What the field
is to add is what the patterns miss, so it learns from hidden mentions: in a copy of each text most
base spans are written as people do write them to other forms (another at sign, other separators,
no country code), and keep their labels; values that stand after a word like token are secrets,
and lose that word in some copies.

Edge cases: null text is empty and has no span; texts and words of any length are read whole, in
time linear in their length; repeated rows get equal spans; null and repeated ids do not matter;
columns of the documents that have the name of a new one give way to it; an empty table gives no
row; without anything to learn from, only base spans are given.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, text_of
from .textpass import add_columns

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
NAMES = (*KINDS, "secret")
# Fixed patterns: the base forms of the contract. A match of theirs never starts inside a run of digits.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

AT = r"[@\uff20]|[\[(]at[\])]"
MARK = re.compile(rf"[0-9]|{AT}")
SPACE = re.compile(r"\s")
CORE = re.compile(r"[^\s.,;:!?()\[\]\"'#$%&*|]")
#: What a secret is learned from: a value after one of these words.
NAMED = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_\-+/]{16,})")
#: Other forms of base spans, as (pattern, replacement); the first of each kind leaves the span as it is.
FORMS = (
    (("", ""), ("@", "\uff20"), ("@", " @ "), ("@", "[at]")),
    (("", ""), (r"\.", "[.]"), (r"\.", " . "), (r"\.", "-")),
    (("", ""), (r"[ -]?(?<=\d{4})(?=\d)", "."), (r"(\d{4})[ -]?(?=\d)", r"\1/"), (r"(\d{4})[ -]?(?=\d)", r"\1_")),
    (("", ""), (r"^\+[0-9]{1,2}[ .-]*", ""), (r"^\+", ""), (r"^\+", "00")),
)
BUCKETS = 1 << 14
FEATURES = 14
SAMPLE = 3000
EPOCHS = 3
SURE = 0.9
AGREE = 1.5
PASSES = 12
HELD = 30.0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, by each @ in turn: its local part is the run before it that no match has taken."""
    out, taken, at = [], 0, text.find("@")
    while at >= 0:
        start, reach = at, 64
        while True:  # the run before the @, looking further back only while it reaches the edge
            low = max(taken, at - reach)
            start = low + LOCAL.search(text[low:at]).start() if low < at else at
            if start > low or low == taken:
                break
            reach *= 4
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        taken = found.end() if found else at + 1
        at = text.find("@", taken)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted; kind by its place in ``KINDS``."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def _f(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def _core(text: str, a: int, b: int) -> tuple[int, int]:
    """The word without punctuation around it."""
    first = CORE.search(text, a, b)
    if first is None:
        return a, a
    while not CORE.match(text, b - 1, b):
        b -= 1
    return first.start(), b


def _has_mark(text: str) -> bool:
    return DIGIT.search(text) is not None or any(x in text for x in ("@", "\uff20", "[at]", "(at)", "[at)", "(at]"))


def _marked(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the words at white space that have a mark, in time linear in the text."""
    end = 0
    for m in MARK.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        stop = SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        yield start, end


def words_of(text: str) -> tuple[list[tuple[int, int]], list[list[int]], list[str]]:
    """Spans, feature buckets and skip keys of the words with a digit or an at sign."""
    spans, features, keys = [], [], []
    for start, end in _marked(text):
        a, b = _core(text, start, end)
        w = text[a:b]
        shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda d: f"9{min(len(d[0]), 20)}", w))
        before = text[max(0, start - 48) : start].split()[-2:]
        after = text[end : end + 24].split()
        only = "".join(c for c in w if c in "0123456789")
        turns = len(re.findall(r"[0-9][A-Za-z]", w))
        marks = "".join(sorted({c for c in w if not c.isalnum()}))
        check = luhn(only) if 14 <= len(only) <= 19 else None
        spans.append((start, end))
        features.append(
            [
                _f("bias"),
                _f("shape " + shape),
                _f(f"digits {min(len(only), 24)}"),
                _f(f"share {len(only) * 8 // max(len(w), 1)}"),
                _f(f"length {min(len(w) // 4, 16)}"),
                _f(f"turns {min(turns // 2, 8)}"),
                _f("marks " + marks[:16]),
                _f(f"only digits {w.isdigit()}"),
                _f(f"check {check}"),
                _f(f"check {check} {marks[:16]}"),
                _f(f"at {re.search(AT, w) is not None} {w.count('.')}"),
                _f("before " + (before[-1].lower() if before else "")),
                _f("before two " + (before[0].lower() if len(before) > 1 else "")),
                _f("after " + (after[0].lower() if after else "")),
            ]
        )
        keys.append("d" + only[-7:] if len(only) >= 7 else "w" + w.lower())
    return spans, features, keys


def edges_of(text: str, spans: list[tuple[int, int]], keys: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs of words side by side, and of each word with the last one of its key."""
    near = [(i - 1, i) for i in range(1, len(spans)) if spans[i][0] - spans[i - 1][1] <= 2]
    side = set(near)
    seen: dict[str, int] = {}
    far = []
    for i, k in enumerate(keys):
        if k in seen and (seen[k], i) not in side:
            far.append((seen[k], i))
        seen[k] = i
    return near, far


def secrets(text: str) -> list[tuple[int, int, int]]:
    """Spans of values named as secrets."""
    return [(m.start(1), SECRET, m.end(1)) for m in NAMED.finditer(text)]


def hidden(text: str, known: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its known spans in other forms, and where they are then. The choice hangs on each span's own text."""
    out, spans, at, size = [], [], 0, 0
    for a, k, b in sorted(known):
        if a < at:
            continue
        value, before = text[a:b], text[at:a]
        pick = zlib.crc32(value.encode())
        if k == SECRET:
            new = value
            if pick % 4 == 0:  # without the word that names it
                before = re.sub(r"(?i)[\w-]+[\"']?\s*[:=]\s*[\"']?\Z", "", before)
        else:
            pattern, form = FORMS[k][pick % len(FORMS[k])]
            new = re.sub(pattern, form, value) if pattern else value
        out += [before, new]
        size += len(before)
        spans.append((size, k, size + len(new)))
        size += len(new)
        at = b
    return "".join([*out, text[at:]]), spans


def gold(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """0, or 1 + kind of the first of the sorted spans ``base`` that overlaps each word."""
    labels, k = [], 0
    for a, b in spans:
        while k < len(base) and base[k][2] <= a:
            k += 1
        labels.append(1 + base[k][1] if k < len(base) and base[k][0] < b else 0)
    return labels


def fit(samples: list[tuple[list[list[int]], list[tuple[int, int]], list[tuple[int, int]], list[int]]], seed: int = 5) -> dict:
    """Unary, transition and skip weights by pseudo-likelihood."""
    n = len(NAMES) + 1
    w, near_w, far_w = np.zeros((BUCKETS, n)), np.zeros((n, n)), AGREE * np.eye(n)  # the prior: linked words agree
    rng = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        rate = 0.5 / (1 + epoch)
        for s in rng.permutation(len(samples)):
            features, near, far, y = samples[s]
            left, right, skips = {}, {}, {}
            for a, b in near:
                right[a], left[b] = b, a
            for a, b in far:
                skips.setdefault(a, []).append(b)
                skips.setdefault(b, []).append(a)
            for i, f in enumerate(features):
                z = w[f].sum(0)
                if i in left:
                    z = z + near_w[y[left[i]]]
                if i in right:
                    z = z + near_w[:, y[right[i]]]
                for j in skips.get(i, ()):
                    z = z + far_w[y[j]]
                e = np.exp(z - z.max())
                g = -e / e.sum()
                g[y[i]] += 1
                w[f] += rate * g
                if i in left:
                    near_w[y[left[i]]] += rate * g
                if i in right:
                    near_w[:, y[right[i]]] += rate * g
                for j in skips.get(i, ()):
                    far_w[y[j]] += rate * 0.5 * g
                    far_w[:, y[j]] += rate * 0.5 * g
    return {"w": w.astype(np.float32), "near": near_w, "far": (far_w + far_w.T) / 2}


def marginals(model: dict, features: list[list[int]], near: list[tuple[int, int]], far: list[tuple[int, int]], known: list[int] | None = None) -> np.ndarray:
    """Beliefs (words, labels) after loopy sum-product passes over all edges at once; ``known`` labels but 0 are held."""
    n = len(NAMES) + 1
    unary = model["w"][np.array(features)].sum(1).astype(np.float64)
    if known is not None:
        at = np.flatnonzero(known)
        unary[at, np.array(known)[at]] += HELD
    edges = np.array([*near, *far], np.int64).reshape(-1, 2)
    if not len(edges):
        e = np.exp(unary - unary.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)
    potentials = np.concatenate((np.broadcast_to(model["near"], (len(near), n, n)), np.broadcast_to(model["far"], (len(far), n, n))))
    source = np.concatenate((edges[:, 0], edges[:, 1]))
    target = np.concatenate((edges[:, 1], edges[:, 0]))
    pot = np.exp(np.clip(np.concatenate((potentials, potentials.transpose(0, 2, 1))), -20, 20))
    back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
    message = np.zeros((len(source), n))
    for _ in range(PASSES):
        belief = unary.copy()
        np.add.at(belief, target, message)
        out = belief[source] - message[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(np.einsum("ei,eij->ej", out, pot) + 1e-300)
        new -= new.max(1, keepdims=True)
        message = 0.5 * message + 0.5 * new
    belief = unary.copy()
    np.add.at(belief, target, message)
    e = np.exp(belief - belief.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], model: dict) -> list[tuple[int, int, int]]:
    """Spans the field adds; they touch no base span."""
    spans, features, keys = words_of(text)
    if not spans:
        return []
    near, far = edges_of(text, spans, keys)
    y = gold(spans, base)
    if all(y):
        return []
    p = marginals(model, features, near, far, y)
    out: list[tuple[int, int, int]] = []
    joined = set(near)
    last = -2
    for i, ((a, b), known) in enumerate(zip(spans, y, strict=True)):
        k = int(p[i].argmax())
        if known or not k or p[i, k] < SURE:
            continue
        a, b = _core(text, a, b)
        if a == b and b < spans[i][1]:  # a sign alone
            a, b = spans[i]
        if out and last == i - 1 and (i - 1, i) in joined and out[-1][1] == k - 1:
            out[-1] = (out[-1][0], k - 1, b)
        else:
            out.append((a, k - 1, b))
        last = i
    return out


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in sorted(spans))


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, as its first kind in brackets."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, k, b in sorted(spans):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    for a, k, b in merged:
        out += [text[at:a], f"[{NAMES[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]]) if merged else text


def example(text: str) -> tuple[list[list[int]], list[tuple[int, int]], list[tuple[int, int]], list[int]]:
    """Features, both kinds of edges and labels of a text with hidden mentions."""
    base = base_spans(text)
    named = [x for x in secrets(text) if all(x[2] <= a or x[0] >= b for a, _, b in base)]
    text, known = hidden(text, [*base, *named])
    spans, features, keys = words_of(text)
    near, far = edges_of(text, spans, keys)
    return features, near, far, gold(spans, known)


def train(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Fit on at most ``sample`` texts that have a digit or an at sign, those of least hash; their features are made where they lie."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("h"), text_of(docs).alias("text")).where(F.col("text").rlike("[0-9@]"))
    chosen = bounded_sample(rows.select("h"), F.col("h"), sample, docs.count()).distinct()  # longs

    def make() -> Callable:
        def run(texts: list[str]) -> list[pa.Array]:
            out = []
            for t in texts:
                features, near, far, y = example(t)
                out.append({"f": [x for f in features for x in f], "near": [x for e in near for x in e], "far": [x for e in far for x in e], "y": y})
            return [pa.array(out, pa.struct([(k, pa.list_(pa.int32())) for k in ("f", "near", "far", "y")]))]

        return run

    kept = rows.join(F.broadcast(chosen), "h")
    got = add_columns(kept, make, "s struct<f: array<int>, near: array<int>, far: array<int>, y: array<int>>", keep=["h"]).orderBy("h").limit(sample).toArrow()
    pairs = lambda x: list(zip(x[::2], x[1::2], strict=True))
    samples = [([s["f"][i : i + FEATURES] for i in range(0, len(s["f"]), FEATURES)], pairs(s["near"]), pairs(s["far"]), s["y"]) for s in got.column("s").to_pylist()]
    return fit(samples) if samples else None


def annotate(docs: DataFrame, model: dict | None, fields: str, of: Callable[[str, list, list], tuple], types: list[pa.DataType], keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns made by ``of`` from (text, base spans, added spans) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights for six labels: 400 kB

    def make() -> Callable:
        m = held.value

        def run(texts: list[str]) -> list[pa.Array]:
            rows = []
            for t in texts:
                base = base_spans(t)
                rows.append(of(t, base, added_spans(t, base, m) if m is not None and _has_mark(t) else []))
            return [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)]

        return run

    return add_columns(docs, make, fields, text=text, keep=keep)


def find_in_documents(docs: DataFrame) -> DataFrame:
    """The contract's rows, the counts being those of the base patterns, with n_added and n_spans, the spans that the field adds and all spans."""

    def row(text: str, base: list, added: list) -> tuple:
        counts = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
        return (*counts, hashlib.sha256(render(base).encode()).hexdigest(), render([*base, *added]), len(added), len(base) + len(added))

    fields = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, n_spans bigint"
    return annotate(docs, train(docs), fields, row, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2, keep=["doc_id"])


def masked_documents(docs: DataFrame) -> DataFrame:
    """Documents with all found spans masked, n_chars of the new text, and their other columns."""
    out = annotate(docs.withColumn("__tidelog_source", text_of(docs)), train(docs), "text string, n_chars bigint", lambda t, base, added: ((m := mask(t, [*base, *added])), len(m)), [pa.string(), pa.int64()], keep=[c for c in docs.columns if c not in ("text", "n_chars")], text="__tidelog_source")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
