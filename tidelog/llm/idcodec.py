"""Token-id files: adaptive context mixing drives a range coder over independently reset blocks.

Ids fall into 256 classes: the most frequent ones are classes of their own, the rest share a few.
Three orders predict the next id. Order 0 holds a class distribution for each block, which starts
at the file's and adapts to the block. Order 1 holds the file's class distribution after each
class of the id before; the two are mixed, with a weight that follows which of them has been right
in the block. Order 2 remembers in a hashed table of the block which id came last after the two
before it, with a chance learned from how such predictions have done, and takes its share of the
interval first. An id of a shared class is then told apart in that class by the file's counts. So
every bit goes through the range coder. A block holds 1024 ids and is reset to the file's counts,
which stand in the header, so any block can be read alone; each has its own CRC-32.

Integers, also as whole floats under 2**53, and single correctly rounded operations keep coder and
decoder alike everywhere. Blocks are lanes: numpy codes thousands of them side by side, a fixed
number of array operations a step.

File: ``MAGIC``, header length (u32), header JSON, length of the packed counts (u32), the counts,
then each block's words. The header holds the documents' ids and lengths and each block's size and
checksum.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np

MAGIC = b"TIDEIDS3"
BLOCK = 1024
#: Blocks coded side by side.
LANES = 8192
CLASSES, SINGLE = 256, 232
MODEL_BITS, MIX_BITS, CODE_BITS, MEMBER_BITS = 14, 8, 22, 16
#: Order 0: the file's share in ids, what one id adds, and the steps at which it is made anew.
PRIOR_IDS, ADD = 512, 16
REFRESH = (0, 32, 96, 256, 512, 768)
#: Order 2: slots of a block's table, the most a prediction is trusted, and the next trust by the last after a miss or a hit.
TABLE_BITS, TRUST = 7, 15
NEXT = np.array([max(t - (t >> 1), 1) for t in range(16)] + [min(t + 1, TRUST) for t in range(16)], np.int32)
RATE = 1 / 32
LIMIT, TOP, LOW32, S16 = float(1 << 32), float(1 << 48), float(1 << 32), float(1 << 16)
CODE, MEMBER = float(1 << CODE_BITS), float(1 << MEMBER_BITS)
#: Classes from one mark to the next; a class is sought by the marks first, which stay in the cache.
MARK = 16
#: Ids counted at once.
PART = 1 << 17


def _shares(counts: np.ndarray, total: int) -> np.ndarray:
    """Whole shares of at least 1 along the last axis that add up to ``total``."""
    n = counts.shape[-1]
    out = counts * (total - n) // np.maximum(counts.sum(-1, keepdims=True), 1) + 1
    top = counts.argmax(-1)[..., None]
    np.put_along_axis(out, top, np.take_along_axis(out, top, -1) + total - out.sum(-1, keepdims=True), -1)
    return out


def _cumulative(shares: np.ndarray) -> np.ndarray:
    out = np.zeros((*shares.shape[:-1], shares.shape[-1] + 1), np.int32)
    np.cumsum(shares, axis=-1, out=out[..., 1:])
    return out


class Counts:
    """A file's counts: ids by class, the members' shares, and the shares of orders 0 and 1."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, zero: np.ndarray, one: np.ndarray, member: np.ndarray):
        """``ids`` by class, ``sizes`` of the classes, shares ``zero`` (classes), ``one`` (classes, classes) and ``member``."""
        self.parts = ids, sizes, zero, one, member
        self.ids = ids.astype(np.int32)
        self.class_of = np.zeros(1 << 16, np.int64)
        self.class_of[ids] = np.repeat(np.arange(CLASSES), sizes)
        starts = np.cumsum(member, dtype=np.int64) - member  # the members of a class share 1 << MEMBER_BITS
        self.starts = starts
        self.member = np.zeros(1 << 16), np.zeros(1 << 16)
        self.member[0][ids], self.member[1][ids] = starts & ((1 << MEMBER_BITS) - 1), member
        self.class_start = np.concatenate(([0], np.cumsum(np.where(sizes > 0, 1 << MEMBER_BITS, 0))))[:-1].astype(np.int64)
        self.first = (np.cumsum(sizes) - sizes).astype(np.int64)
        self.shared = sizes > 1
        self.zero = zero.astype(np.int64)
        whole = _cumulative(one.astype(np.int32))
        self.one, self.one_marks = whole.reshape(-1), np.ascontiguousarray(whole[:, :CLASSES:MARK]).reshape(-1)

    @classmethod
    def of(cls, flat: np.ndarray) -> Counts:
        counts = np.zeros(1 << 16, np.int64)
        for at in range(0, len(flat), PART):
            counts += np.bincount(flat[at : at + PART], minlength=1 << 16)
        ids = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        n = counts[ids]
        groups = CLASSES - SINGLE
        rest = n[SINGLE:] if len(ids) > CLASSES else n[:0]
        before = np.cumsum(rest) - rest
        of = np.arange(len(ids)) if not len(rest) else np.concatenate((np.arange(SINGLE), SINGLE + before * groups // max(int(rest.sum()), 1)))
        sizes = np.bincount(of, minlength=CLASSES)
        member = np.concatenate([_shares(part, 1 << MEMBER_BITS) for part in np.split(n, np.cumsum(sizes)[:-1]) if len(part)]) if len(ids) else n
        class_of = np.zeros(1 << 16, np.int64)
        class_of[ids] = of
        pairs = np.zeros(CLASSES * CLASSES, np.int64)
        for at in range(0, len(flat), PART):
            seen = class_of.take(flat[at : at + PART + 1])  # and the first of the next part
            pairs += np.bincount(seen[:-1] * CLASSES + seen[1:], minlength=CLASSES * CLASSES)
        pairs = pairs.reshape(CLASSES, CLASSES)
        zero = np.bincount(of, counts[ids], minlength=CLASSES).astype(np.int64)
        total = 1 << MODEL_BITS
        return cls(ids.astype(np.uint16), sizes.astype(np.uint16), _shares(zero, total).astype(np.uint16), _shares(pairs, total).astype(np.uint16), member.astype(np.uint32))

    def pack(self) -> bytes:
        return zlib.compress(b"".join([struct.pack("<I", len(self.ids)), *(np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<")).tobytes() for x in self.parts)]), 6)

    @classmethod
    def unpack(cls, raw: bytes) -> Counts:
        raw = zlib.decompress(raw)
        (n,) = struct.unpack_from("<I", raw)
        at, found = 4, []
        for size, kind in ((n, "<u2"), (CLASSES, "<u2"), (CLASSES, "<u2"), (CLASSES * CLASSES, "<u2"), (n, "<u4")):
            found.append(np.frombuffer(raw, kind, size, at))
            at += found[-1].nbytes
        return cls(*found[:3], found[3].reshape(CLASSES, CLASSES), found[4])


class Models:
    """The three orders' states of many lanes."""

    def __init__(self, counts: Counts, lanes: int):
        n, self.file = lanes, counts
        self.zero_at = np.arange(n, dtype=np.int64) * (CLASSES + 1)
        self.mark_at = np.arange(n, dtype=np.int64) * (CLASSES // MARK)
        self.seen = np.tile(((counts.zero * (PRIOR_IDS * ADD) >> MODEL_BITS) + 1).astype(np.uint16), (n, 1))
        self.seen_at = np.arange(n, dtype=np.int64)[:, None] * CLASSES
        self.zero = np.zeros((n, CLASSES + 1), np.int32)
        self.latest: list[np.ndarray] = []
        self.weight = np.full(n, 0.75)  # of order 1
        self.table_at = np.arange(n, dtype=np.int64) << TABLE_BITS
        self.table = np.zeros(n << TABLE_BITS, np.int32)  # the id that came last, and from bit 16 its trust
        self.once, self.often = np.full(n, 0.4), np.full(n, 0.7)  # chances of predictions that have trust 1, and more
        self.first = np.zeros(n, np.int32)
        self.second = np.zeros(n, np.int32)
        self.before = np.zeros(n, np.int64)
        self.one_at = np.zeros(n, np.int64)
        self.step = 0

    def _refresh(self) -> None:
        if self.latest:
            np.add.at(self.seen.reshape(-1), self.seen_at + np.stack(self.latest, axis=1), np.uint16(ADD))
            self.latest = []
        for at in range(0, len(self.seen), 512):
            cum = np.cumsum(self.seen[at : at + 512], axis=1, dtype=np.int32)
            cum = (cum * (((1 << MODEL_BITS) - CLASSES) / cum[:, -1:])).astype(np.int32)
            cum += np.arange(1, CLASSES + 1, dtype=np.int32)
            cum[:, -1] = 1 << MODEL_BITS
            self.zero[at : at + 512, 1:] = cum
        self.zeros, self.zero_marks = self.zero.reshape(-1), np.ascontiguousarray(self.zero[:, :CLASSES:MARK]).reshape(-1)

    def predict(self) -> None:
        """Sets ``guess`` and its share ``head`` of the interval, the ``rest``, and the mixture's weights."""
        if self.step in REFRESH:
            self._refresh()
        mixed = self.first * np.int32(40503)  # its low 16 bits count, also beyond 32
        mixed += self.second * np.int32(30011)
        mixed &= 0xFFFF
        mixed >>= 16 - TABLE_BITS
        self.slot = self.table_at + mixed
        self.entry = self.table.take(self.slot)
        self.guess, self.trust = self.entry & 0xFFFF, self.entry >> 16
        self.at1, self.at2 = self.trust == 1, self.trust > 1
        self.is2 = self.at2.astype(float)
        self.p = self.once * self.at1 + self.often * self.is2
        self.head = np.floor(self.p * CODE)
        self.rest = CODE - self.head
        self.w1 = (self.weight * (1 << MIX_BITS)).astype(np.int32)
        self.w0 = (1 << MIX_BITS) - self.w1

    def interval(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the class in the interval, after ``head``."""
        at = self.one_at + kind
        low1 = self.file.one.take(at, mode="clip")
        low1 *= self.w1
        at += 1
        high1 = self.file.one.take(at, mode="clip")
        high1 *= self.w1
        at = self.zero_at + kind
        low0 = self.zeros.take(at, mode="clip")
        low0 *= self.w0
        at += 1
        high0 = self.zeros.take(at, mode="clip")
        high0 *= self.w0
        self.share1 = (high1 - low1).astype(float)
        self.share = self.share1 + (high0 - low0)
        scale = self.rest * (1 / CODE)
        low = np.floor((low1 + low0) * scale)
        return low + self.head, np.floor((high1 + high0) * scale) - low

    def _last(self, one: np.ndarray, zero: np.ndarray, at: np.ndarray, far: np.ndarray, aim: np.ndarray) -> np.ndarray:
        """The last of 16 entries from ``at`` in ``one`` (``far`` on in ``zero``) that start at or before ``aim``."""
        for step in (8, 4, 2, 1):
            ahead = at + step
            below = one.take(ahead, mode="clip")
            below *= self.w1
            ahead += far
            other = zero.take(ahead, mode="clip")
            other *= self.w0
            below += other
            at = at + (below <= aim) * np.int64(step)
        return at

    def find(self, aim: np.ndarray) -> np.ndarray:
        """The last class that starts at or before ``aim``."""
        near = self.before * MARK
        mark = self._last(self.file.one_marks, self.zero_marks, near, self.mark_at - near, aim) - near
        return self._last(self.file.one, self.zeros, self.one_at + mark * MARK, self.zero_at - self.one_at, aim) - self.one_at

    def update(self, ids: np.ndarray, kind: np.ndarray, hit: np.ndarray, miss: np.ndarray) -> None:
        """``ids`` int32; ``hit`` and ``miss`` of the guess as floats."""
        self.weight += (self.share1 / self.share - self.weight) * RATE
        np.minimum(np.maximum(self.weight, 0.05, out=self.weight), 0.95, out=self.weight)
        self.latest.append(kind)
        # chances follow the guesses; a hit adds trust, a miss takes half away, and a guess of trust 1 gives way
        p = self.p
        p += (hit - p) * RATE
        np.minimum(np.maximum(p, 0.02, out=p), 0.98, out=p)
        np.copyto(self.once, p, where=self.at1)
        np.copyto(self.often, p, where=self.at2)
        goes = (miss > self.is2).astype(np.int32)
        trust = NEXT.take(self.trust + 16 * hit.astype(np.int32))
        self.table[self.slot] = (self.guess + (ids - self.guess) * goes) | (trust << 16)
        self.second, self.first = self.first, ids
        self.before, self.one_at = kind, kind * (CLASSES + 1)
        self.step += 1


class Coder:
    """Range coders of many lanes: words of 16 bits go to each lane's row, carries beside them. Whole floats hold the state."""

    def __init__(self, lanes: int, words: int):
        self.low, self.width = np.zeros(lanes), np.full(lanes, TOP)
        self.words, self.carries = np.zeros((lanes, words), np.uint16), np.zeros((lanes, words), np.uint16)
        self.row = np.arange(lanes, dtype=np.int64) * words
        self.at = self.row.copy()

    def _carry(self, lanes: np.ndarray) -> None:
        self.low[lanes] -= TOP
        self.carries.reshape(-1)[self.at[lanes] - 1] += np.uint16(1)

    def _some(self, at: np.ndarray) -> None:
        """Words of the lanes ``at`` whose width is small."""
        while at.size:
            low = self.low[at]
            word = np.floor(low * (1 / LOW32))
            self.words.reshape(-1)[self.at[at]] = word.astype(np.uint16)
            self.at[at] += 1
            self.low[at] = (low - word * LOW32) * S16
            self.width[at] = width = self.width[at] * S16
            at = at[width < LIMIT]

    def every(self, start: np.ndarray, size: np.ndarray) -> None:
        """Narrow all lanes, by parts of CODE."""
        r = np.floor(self.width * (1 / CODE))
        self.low += r * start
        self.width = r * size
        over = self.low >= TOP
        if over.any():
            self._carry(np.flatnonzero(over))
        short = self.width < LIMIT
        at = np.flatnonzero(short)
        word = np.floor(self.low * (1 / LOW32))
        self.words.reshape(-1)[self.at.take(at)] = word.take(at).astype(np.uint16)
        self.at += short
        short = short.astype(float)
        grow = short * (S16 - 1) + 1
        self.low = (self.low - word * short * LOW32) * grow
        self.width *= grow
        if self.width.min(initial=TOP) < LIMIT:
            self._some(np.flatnonzero(self.width < LIMIT))

    def some(self, who: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Narrow the lanes ``who``, by parts of MEMBER."""
        r = np.floor(self.width.take(who) * (1 / MEMBER))
        low, width = self.low.take(who) + r * start, r * size
        self.low[who], self.width[who] = low, width
        over = low >= TOP
        if over.any():
            self._carry(who[over])
        self._some(who[width < LIMIT])

    def finish(self) -> list[bytes]:
        for shift in (LOW32, S16, 1.0):
            self.words.reshape(-1)[self.at] = (np.floor(self.low / shift) % S16).astype(np.uint16)
            self.at += 1
        out = []
        for i, n in enumerate((self.at - self.row).tolist()):
            words, carries = self.words[i, :n], self.carries[i, :n]
            if carries.any():
                total = int.from_bytes(words.astype(">u2").tobytes()) + int.from_bytes(carries.astype(">u2").tobytes())
                words = np.frombuffer(total.to_bytes(2 * n), ">u2")
            out.append(words.astype("<u2").tobytes())
        return out


def encode_blocks(blocks: np.ndarray, counts: Counts) -> list[bytes]:
    """The words of each row of ids (n, BLOCK)."""
    n, length = blocks.shape
    m, coder = Models(counts, n), Coder(n, length * (CODE_BITS + MEMBER_BITS) // 16 + 8)
    columns = np.ascontiguousarray(blocks.T)
    for t in range(length):
        ids = columns[t].astype(np.int32)
        kind = counts.class_of.take(ids)
        m.predict()
        guessed = (m.guess == ids) & (m.head > 0)
        hit = guessed.astype(float)
        miss = 1 - hit
        start, size = m.interval(kind)
        coder.every(start * miss, m.head * hit + size * miss)
        who = np.flatnonzero(counts.shared.take(kind) > guessed)
        if who.size:
            some = ids.take(who)
            coder.some(who, counts.member[0].take(some), counts.member[1].take(some))
        m.update(ids, kind, hit, miss)
    return coder.finish()


class Decoder:
    """The other side of ``Coder``."""

    def __init__(self, parts: list[bytes]):
        most = max(map(len, parts)) // 2 + 4
        self.words = np.zeros((len(parts), most), np.uint16)
        for i, w in enumerate(parts):
            self.words[i, : len(w) // 2] = np.frombuffer(w, "<u2")
        first = self.words[:, :3].astype(float)
        self.words = self.words.reshape(-1)
        self.value = first[:, 0] * LOW32 + first[:, 1] * S16 + first[:, 2]
        self.width = np.full(len(parts), TOP)
        self.at = np.arange(len(parts), dtype=np.int64) * most + 3

    def _some(self, at: np.ndarray) -> None:
        while at.size:
            self.value[at] = self.value[at] * S16 + self.words.take(self.at[at], mode="clip")
            self.at[at] += 1
            self.width[at] = width = self.width[at] * S16
            at = at[width < LIMIT]

    def place(self) -> np.ndarray:
        """Each lane's place in its interval, of CODE. Quotients of whole floats this small floor exactly."""
        self.r = np.floor(self.width * (1 / CODE))
        return np.minimum(np.floor(self.value / self.r), CODE - 1)

    def every(self, start: np.ndarray, size: np.ndarray) -> None:
        self.value -= self.r * start
        self.width = self.r * size
        short = self.width < LIMIT
        grow = short * (S16 - 1) + 1
        self.value = self.value * grow + self.words.take(self.at, mode="clip") * short
        self.at += short
        self.width *= grow
        if self.width.min(initial=TOP) < LIMIT:
            self._some(np.flatnonzero(self.width < LIMIT))

    def member(self, who: np.ndarray, kind: np.ndarray, counts: Counts) -> np.ndarray:
        """The ids of the lanes ``who`` in their shared classes."""
        r = np.floor(self.width.take(who) * (1 / MEMBER))
        value = self.value.take(who)
        place = np.minimum(np.floor(value / r), MEMBER - 1).astype(np.int64)
        found = counts.ids.take(np.searchsorted(counts.starts, counts.class_start.take(kind) + place, side="right") - 1)
        self.value[who] = value - r * counts.member[0].take(found)
        self.width[who] = width = r * counts.member[1].take(found)
        self._some(who[width < LIMIT])
        return found


def decode_blocks(parts: list[bytes], counts: Counts, length: int = BLOCK) -> np.ndarray:
    """The ids (n, length) of coded blocks."""
    m, coder = Models(counts, len(parts)), Decoder(parts)
    out = np.zeros((length, len(parts)), np.uint16)
    leaders = counts.ids.take(counts.first, mode="clip")  # the first id of each class
    for t in range(length):
        m.predict()
        q = coder.place()
        guessed = q < m.head
        hit = guessed.astype(float)
        miss = 1 - hit
        aim = np.floor(((np.maximum(q - m.head, 0) + 1) * CODE - 1) / m.rest).astype(np.int32)
        ids = np.where(guessed, m.guess, leaders.take(m.find(aim)))
        kind = counts.class_of.take(ids)
        start, size = m.interval(kind)
        coder.every(start * miss, m.head * hit + size * miss)
        who = np.flatnonzero(counts.shared.take(kind) > guessed)
        if who.size:
            ids[who] = coder.member(who, kind.take(who), counts)
        out[t] = ids
        m.update(ids, kind, hit, miss)
    return np.ascontiguousarray(out.T)


def pack_file(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A file of documents in the order given."""
    lengths = [len(x) for x in ids]
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    counts = Counts.of(flat)
    count = -(-len(flat) // BLOCK)
    blocks = np.zeros(count * BLOCK, np.uint16)
    blocks[: len(flat)] = flat
    if len(flat):
        blocks[len(flat) :] = counts.ids[0]  # what fills the last block is an id that has a class
    blocks = blocks.reshape(count, BLOCK)
    body, table = [], []
    for at in range(0, count, LANES):
        group = blocks[at : at + LANES]
        for row, words in zip(group, encode_blocks(group, counts), strict=True):
            body.append(words)
            table.append((len(words), zlib.crc32(row.astype("<u2").tobytes())))
    header = json.dumps({"block": BLOCK, "docs": doc_ids, "lengths": lengths, "blocks": table}).encode()
    packed = counts.pack()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, struct.pack("<I", len(packed)), packed, *body])


def unpack_file(raw: bytes):
    """Yields (doc_id, ids) of a file; wrong magic or checksums raise ValueError."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token-id file")
    (n,) = struct.unpack_from("<I", raw, 8)
    header = json.loads(raw[12 : 12 + n])
    at = 12 + n
    (n,) = struct.unpack_from("<I", raw, at)
    counts = Counts.unpack(raw[at + 4 : at + 4 + n])
    at, parts = at + 4 + n, []
    for size, _ in header["blocks"]:
        parts.append(raw[at : at + size])
        at += size
    flat = np.zeros((len(parts), header["block"]), np.uint16)
    with np.errstate(all="ignore"):  # spoilt words decode to something, which the checksum then tells
        for i in range(0, len(parts), LANES):
            flat[i : i + LANES] = decode_blocks(parts[i : i + LANES], counts, header["block"])
    for row, (_, crc) in zip(flat, header["blocks"], strict=True):
        if zlib.crc32(row.astype("<u2").tobytes()) != crc:
            raise ValueError("block checksum mismatch")
    flat = flat.reshape(-1)
    start = 0
    for doc, length in zip(header["docs"], header["lengths"], strict=True):
        yield doc, flat[start : start + length]
        start += length
