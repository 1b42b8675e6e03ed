"""Token ids of whole texts by the tokenizers library, with a bounded cache of words.

The vocabulary's splitting never crosses white space, so a text's ids are its chunks' ids in
order, and each new chunk is encoded once a worker. The chunks of Latin-1 texts are split and made
distinct by Arrow, call by call, so a frequent one is looked up once; the table of known chunks is a few numpy arrays. Latin-1 text is lower-cased and split into
words, digits and symbol runs here, by the tokenizer file's own pattern, and the library's BPE
model encodes the batch's new words together; any other chunk, and any text with special tokens
or odd separators, is encoded by the full tokenizer. Both give the library's ids exactly.
"""

from __future__ import annotations

import json
import os
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache
from .shingles import GOLD, mix

#: Latin-1 chunks kept by a worker, and the longest of them in bytes: some 30 MB. The first met stay; after ``RENEW`` misses for each the table is begun anew.
CACHE_WORDS, CACHE_BYTES, RENEW = 500_000, 24, 8
#: Other chunks kept by a worker, and the longest of them: some 20 MB.
OTHER_WORDS, OTHER_CHARS = 100_000, 64
#: The pattern of the tokenizer file, for lower-cased Latin-1: letters are a-z, the three letter signs and 0xDF-0xFF but for the division sign.
LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
#: Separators of str.split that the pattern takes for symbols.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: What fills a chunk up to ``CACHE_BYTES``.
FILL = "\0"
#: Latin-1 in lower case, which stays Latin-1; its two separators beyond ASCII become spaces.
LOWER = bytes(0x20 if b in (0x85, 0xA0) else ord(chr(b).lower()) for b in range(256))
END = "</w>"
MARKS = frozenset(".,;:!?")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's alphabet: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Encodes texts to uint16 arrays."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.load(open(file, encoding="utf-8"))
        self.full = Tokenizer.from_file(file)
        bare = {**spec, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.words = Tokenizer.from_str(json.dumps(bare))
        vocab = self.full.get_vocab(with_added_tokens=True)
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(END)]] = True
        self.letters = {chr(b): c for b, c in _byte_letters().items()}
        self.wide = {b: "".join(self.letters[chr(x)] for x in chr(b).encode()) for b in range(256)} | {32: " "}
        self._begin()
        self.known: dict[str, bytes] = {}  # chunks of texts beyond Latin-1
        self.missed_other = 0

    def _begin(self) -> None:
        """A table with the empty chunk, to which outer white space splits.

        By place: the filled chunks, where their ids start in ``flat``, and how many they are. ``hashes``
        are in order, with their places beside them; a chunk is told by all its bytes.
        """
        self.chunks = np.zeros((1, CACHE_BYTES // 8), np.uint64)
        self.hashes, self.places = _hashes(self.chunks), np.zeros(1, np.int32)
        self.starts, self.lengths, self.flat = np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(0, np.uint16)
        self.missed = 0

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-cased Latin-1 chunks, one after the other, and how many each has, from the library's model, many words to a call."""
        flat, lengths = [np.zeros(0, np.uint16)], [np.zeros(0, np.int32)]
        for at in range(0, len(chunks), 2000):
            part = chunks[at : at + 2000]
            spaced, count = [], []
            for c in part:
                if c.isalpha():
                    spaced.append(c)
                    count.append(1)
                elif c[-1] in MARKS and c[:-1].isalpha():
                    spaced.append(f"{c[:-1]} {c[-1]}")
                    count.append(2)
                else:
                    pieces = PIECES.findall(c)
                    spaced.append(" ".join(pieces))
                    count.append(len(pieces))
            line = " ".join(spaced)
            if not (line.isascii() and line.isprintable()):
                line = line.translate(self.wide)
            ids = np.array(self.words.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint16)
            ends = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum(count)
            if len(ends) != last[-1]:
                raise ValueError("the vocabulary does not end words as expected")
            flat.append(ids)
            lengths.append(np.diff(ends[last - 1], prepend=0).astype(np.int32))
        return np.concatenate(flat), np.concatenate(lengths)

    def _whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def _find(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of distinct Latin-1 chunks, and the starts, lengths and ids that these are of. New ones are encoded, and kept while there is room."""
        table = self.starts, self.lengths, self.flat
        short = pc.binary_length(distinct).to_numpy() <= CACHE_BYTES
        chunks = _filled(distinct.filter(pa.array(short)))
        h = _hashes(chunks)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        place = self.places.take(at)
        hit = (self.chunks.take(place, axis=0) == chunks).all(1)
        places = np.full(len(distinct), -1, np.int32)
        places[short] = np.where(hit, place, -1)
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = np.arange(len(table[0]), len(table[0]) + len(new))
            flat, lengths = self._encode(distinct.take(pa.array(new)).to_pylist())
            table = _joined(*table, flat, lengths)
            if (room := CACHE_WORDS - len(self.chunks)) > 0:
                _, first = np.unique(h, return_index=True)  # one of a hash
                fresh = np.zeros(len(h), bool)
                fresh[first] = True
                fresh = np.flatnonzero(fresh & ~hit & (self.hashes.take(at) != h))[:room]
                fits = np.zeros(len(distinct), bool)
                fits[np.flatnonzero(short)[fresh]] = True
                fits = fits[new]
                order = np.argsort(h[fresh])
                spots = np.searchsorted(self.hashes, h[fresh][order])
                self.places = np.insert(self.places, spots, len(self.chunks) + order)
                self.hashes = np.insert(self.hashes, spots, h[fresh][order])
                self.chunks = np.concatenate((self.chunks, chunks[fresh]))
                self.starts, self.lengths, self.flat = _joined(self.starts, self.lengths, self.flat, flat[np.repeat(fits, lengths)], lengths[fits])
            else:
                self.missed += len(new)
                if self.missed > RENEW * CACHE_WORDS:
                    self._begin()
        return places, *table

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of new chunks beyond Latin-1; they are kept while there is room."""
        made = {c: self._whole(c) for c in chunks}
        if len(self.known) < OTHER_WORDS:
            self.known.update(x for x in made.items() if len(x[0]) <= OTHER_CHARS)
        else:
            self.missed_other += len(made)
            if self.missed_other > RENEW * OTHER_WORDS:
                self.known, self.missed_other = {}, 0
        return made

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of lower-cased Latin-1 texts. Arrow splits them and tells their distinct chunks, and only those are looked up."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = pc.dictionary_encode(split.values)
        places, starts, lengths, flat = self._find(coded.dictionary)
        index = places.take(coded.indices.to_numpy())
        n = lengths.take(index)
        ends = np.cumsum(n, dtype=np.int32 if len(index) < 1 << 24 else np.int64)
        at = np.repeat(starts.take(index) - ends + n, n)
        at += np.arange(len(at), dtype=np.int32)
        ids = flat.take(at)
        cuts = np.concatenate(([0], ends)).take(split.offsets.to_numpy()).tolist()
        return [ids[a:b] for a, b in pairwise(cuts)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The arrays of a call may share memory."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain: list[tuple[int, str]] = []
        waiting: list[tuple[int, list[str], list[bytes | None]]] = []
        other: set[str] = set()
        for i, t in enumerate(texts):
            if "<|" in t or FILL in t or any(c in t for c in ODD):
                out[i] = np.frombuffer(self._whole(t), np.uint16)
            elif (lower := _lower_latin(t)) is not None:
                plain.append((i, lower))
            else:
                chunks = [f" {c}" for c in t.split()]  # a space marks those that the full tokenizer takes
                found = list(map(self.known.get, chunks))
                other.update(c for c, ids in zip(chunks, found, strict=True) if ids is None)
                waiting.append((i, chunks, found))
        if plain:
            for (i, _), ids in zip(plain, self._plain([t for _, t in plain]), strict=True):
                out[i] = ids
        if waiting:
            made = self._learn(other) if other else {}
            for i, chunks, found in waiting:
                out[i] = np.frombuffer(b"".join([made[c] if ids is None else ids for c, ids in zip(chunks, found, strict=True)]), np.uint16)
        return out


def _filled(chunks: pa.Array) -> np.ndarray:
    """Chunks of at most ``CACHE_BYTES``, filled up to that many, as rows of longs."""
    filled = pc.ascii_rpad(chunks, width=CACHE_BYTES, padding=FILL)
    return np.frombuffer(b"" if not len(chunks) else filled.buffers()[2], np.uint64, len(chunks) * CACHE_BYTES // 8).reshape(-1, CACHE_BYTES // 8)


def _hashes(filled: np.ndarray) -> np.ndarray:
    h = np.full(len(filled), GOLD)
    for column in filled.T:
        h = mix(h ^ column)
    return h


def _joined(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray, more: np.ndarray, more_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A table of ids with more of them behind."""
    more_starts = np.cumsum(more_lengths, dtype=np.int32) - more_lengths + np.int32(len(flat))
    return np.concatenate((starts, more_starts)), np.concatenate((lengths, more_lengths)), np.concatenate((flat, more))


def _lower_latin(text: str) -> str | None:
    """Latin-1 text in lower case, with white space of ASCII alone; None for any other text."""
    if text.isascii():
        return text.lower()
    try:
        return text.encode("latin-1").translate(LOWER).decode("latin-1")
    except UnicodeEncodeError:
        return None


def word_ids(file: str) -> WordIds:
    """A worker's encoder for a file, kept between tasks."""
    return worker_cache(f"words {file}", lambda: WordIds(file))


def batches_of(texts: list[str], chars: int = 4_000_000):
    """(from, to) of runs of texts with about so many characters."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The public vocabulary's place on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
