"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Every item has a bag of word shingles (five words, or all of a shorter item) and the 64-bit
SimHash of that bag. A document's windows of an item's length are fingerprinted alike, and eight
blocks of eight bits find candidates among the items of that length: an item is one if some block
of its fingerprint is within two bits of the window's, so an item within 23 bits of a window
agrees with it in some block. Candidates within ``RADIUS`` are verified by the weighted Jaccard
similarity of their shingles. Only windows that share a shingle with a benchmark item are
fingerprinted, and compared with the items that the document shares one with: any other has
similarity 0. For items longer than the document, the whole document is the one window; items too
long for it to reach the similarity are left out.

The benchmark is read in blocks (by hashed ids) of about ``BLOCK_ITEMS`` items and ``BLOCK_BYTES``
of text; each block is a broadcast, a worker keeps its index, and all documents meet every block.

Edge cases: null or empty items match nothing; items shorter than five words match as a whole run
of their words; repeated items match each; null and empty documents match nothing; documents
of any length are read whole, and those shorter than an item are compared whole; of windows of
equal similarity the first is given; repeated documents match each; case, and punctuation around
words, do not count; columns of the documents but doc_id and text are not read, whatever their
names; an empty table of either kind gives no row.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, stage, text_of, worker_cache
from .shingles import WIDTH, Words, hashes, overlap, shingles
from .textpass import add_columns

SIMILARITY = 0.8
BLOCKS, BITS, NEAR = 8, 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
FILTER_BITS = 22
#: Windows fingerprinted at once, and pairs of a window and an item compared at once.
STRETCH, NEAR_CELLS = 4096, 1 << 19
WORD = re.compile(r"\w+")
MATCH = "item_id bigint, similarity double, hamming int, first_word bigint, n_words bigint, start bigint, end bigint"
#: Bits set in each byte.
BITS_SET = np.array([x.bit_count() for x in range(1 << BITS)], np.uint8)


def signs(h: np.ndarray) -> np.ndarray:
    """(shingles, 64) of +1 and -1 by the hashes' bits."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def simhash(total: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of (n, 64) sums of signs."""
    return np.packbits(total > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


class Items:
    """A block of items: shingle index by width, and by length the fingerprints in blocks of bits."""

    def __init__(self, rows: list[tuple[int, str]], table: Words):
        self.ids, self.bags, self.prints, self.sizes = [], [], [], []
        by_shingle: dict[int, dict[int, list[int]]] = {}
        for item, text in rows:
            h = hashes(WORD.findall(text.lower()), table)
            if not len(h):
                continue
            s = shingles(h)
            for x in set(s.tolist()):
                by_shingle.setdefault(min(WIDTH, len(h)), {}).setdefault(x, []).append(len(self.ids))
            self.ids.append(item)
            self.bags.append(np.unique(s, return_counts=True))
            self.prints.append(int(simhash(signs(s).sum(0, keepdims=True))[0]))
            self.sizes.append(len(h))
        self.having = by_shingle
        self.filters = {}
        for w, of in by_shingle.items():
            f = np.zeros(1 << FILTER_BITS, bool)
            f[(np.array(list(of), np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.filters[w] = f
        self.blocks = np.array(self.prints, "<u8").view(np.uint8).reshape(-1, BLOCKS)

    def near(self, prints: np.ndarray, items: list[int]) -> list[tuple[int, int, int]]:
        """(place in ``prints``, item, distance) of the given items within the radius, by their blocks."""
        mine, out = self.blocks[items], []
        step = max(1, NEAR_CELLS // len(items))
        for start in range(0, len(prints), step):
            apart = BITS_SET[prints[start : start + step].astype("<u8").view(np.uint8).reshape(-1, 1, BLOCKS) ^ mine]
            total = apart.sum(2)
            at, k = np.nonzero((apart <= NEAR).any(2) & (total <= RADIUS))
            out += [(start + p, items[i], d) for p, i, d in zip(at.tolist(), k.tolist(), total[at, k].tolist(), strict=True)]
        return out

    def candidates(self, print_: int, size: int, longest: int | None = None) -> list[tuple[int, int]]:
        """(item, distance) of the items of ``size`` (to ``longest``) words within the radius."""
        items = [i for i, n in enumerate(self.sizes) if size <= n <= (longest or size)]
        return [(i, d) for _, i, d in self.near(np.array([print_], np.uint64), items)] if items else []

    def matches(self, words: np.ndarray, similarity: float) -> list[tuple[int, float, int, int, int]]:
        """(item, similarity, distance, first word, words) of the best window of each matching item."""
        best: dict[int, tuple[float, int, int, int]] = {}
        for width, of in self.having.items():
            if len(words) < width:
                continue
            s = shingles(words, width)
            hits = [int(k) for k in np.flatnonzero(self.filters[width][(s >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]) if int(s[k]) in of]
            shared = {i for k in hits for i in of[int(s[k])]}  # items with a shingle of the document
            longer = [i for i in shared if self.sizes[i] > len(words) and len(s) / (self.sizes[i] - width + 1) >= similarity]
            if longer:
                whole = np.unique(s, return_counts=True)
                for _, i, d in self.near(simhash(signs(s).sum(0, keepdims=True)), sorted(longer)):
                    got = overlap(whole, self.bags[i])
                    if got >= similarity:
                        best[i] = (got, d, 0, len(words))
            by_size: dict[int, list[int]] = {}
            for i in sorted(shared):
                if self.sizes[i] <= len(words):
                    by_size.setdefault(self.sizes[i], []).append(i)
            for n, items in by_size.items():
                mine = set(items)
                spots: set[int] = set()
                for k in hits:
                    if not mine.isdisjoint(of[int(s[k])]):
                        spots.update(range(max(0, k + width - n), min(k, len(words) - n) + 1))
                first = np.array(sorted(spots))
                run = n - width + 1
                # neighbouring windows share their sums: one running total a stretch
                for piece in np.split(first, np.flatnonzero(np.diff(first) > run) + 1):
                    for part in np.split(piece, range(STRETCH, len(piece), STRETCH)):
                        a, z = part[0], part[-1] + run
                        total = np.vstack((np.zeros((1, 64), np.int32), np.cumsum(signs(s[a:z]), axis=0)))
                        prints = simhash(total[part - a + run] - total[part - a])
                        for p, i, d in self.near(prints, items):
                            at = int(part[p])
                            got = overlap(np.unique(s[at : at + run], return_counts=True), self.bags[i])
                            if got >= similarity and (i not in best or got > best[i][0]):
                                best[i] = (got, d, at, n)
        return [(self.ids[i], v, d, p, n) for i, (v, d, p, n) in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id and the best window of every document and item that match."""
    return _matching(docs, benchmark, similarity).drop("_node")


def _matching(docs: DataFrame, benchmark: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``contaminated`` with the hash of the document's text, ``_node``."""
    size = benchmark.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["b"] // BLOCK_BYTES))
    out = None
    for k in range(blocks):
        mine = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).where("text is not null")
        rows = [(r["item_id"], r["text"]) for r in mine.select("item_id", F.col("text").cast("string").alias("text")).collect()]  # about BLOCK_ITEMS rows and BLOCK_BYTES
        held = docs.sparkSession.sparkContext.broadcast(rows)

        def index(held=held) -> tuple[Words, Items]:
            table = Words()
            return table, Items(held.value, table)

        def make(index=index, name=f"items {uuid.uuid4().hex}") -> Callable:
            table, items = worker_cache(name, index)
            fields = [x.split()[0] for x in MATCH.split(", ")]

            def run(texts: list[str]) -> list[pa.Array]:
                found = []
                for t in texts:
                    low = t.lower()
                    words = hashes(WORD.findall(low), table)
                    got = items.matches(words, similarity) if items.ids else []
                    if got:
                        spans = [m.span() for m in WORD.finditer(t if len(low) == len(t) else low)]
                        found.append([dict(zip(fields, (i, v, d, p, n, spans[p][0], spans[p + n - 1][1]), strict=True)) for i, v, d, p, n in got])
                    else:
                        found.append([])
                kind = pa.list_(pa.struct([pa.field(f, {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}[t]) for f, t in (x.split() for x in MATCH.split(", "))]))
                return [pa.array(found, kind)]

            return run

        fields = ", ".join(f"{n}: {t}" for n, t in (x.split() for x in MATCH.split(", ")))
        texts = docs.select(F.col("doc_id"), F.xxhash64(text_of(docs)).alias("_node"), text_of(docs).alias("text"))
        part = add_columns(texts, make, f"hits array<struct<{fields}>>", keep=["doc_id", "_node"])
        part = part.select("doc_id", "_node", F.explode("hits").alias("m")).select("doc_id", "_node", "m.*")
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that match no item, with their columns as they were.

    Rows are told apart by text and id, so a clean row that repeats an id, or has none, stays.
    """
    mark, key = "__tidelog_node", "__tidelog_id"
    found = _matching(docs, benchmark, similarity).select(F.col("_node").alias(mark), F.col("doc_id").alias(key))
    bad = small_side(stage(found.distinct(), "contaminated"))
    same = (F.xxhash64(text_of(docs)) == bad[mark]) & docs["doc_id"].eqNullSafe(bad[key])
    return docs.join(bad, same, "left_anti")
