"""The ten operators on a small table with odd rows, against brute force, round trips or held-out accuracy."""

import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import bagminhash, common, decontam, idcodec, idfiles, langid, merkle, packing, pii, quality, sharding, tokens, warc
from tidelog.llm.common import bounded_sample, rank_within
from tidelog.llm.shingles import Words, bag, overlap

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, selected int, _text string"
EN = "the thing and ered of tion in heon that re with or an was to be is on for this".split()
DE = "der und die ein ich für über mit nicht auch von zu das schön wird sich dem".split()


def make(n=120, seed=1):
    """Documents with copies, near copies, nulls, ties, long texts, personal data and clashing columns."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = EN if i % 3 else DE
        text = " ".join(r.choice(words) + r.choice(["", "a", "ing", "ed", "x"]) for _ in range(r.randint(1, 160)))
        rows.append([i, text.replace(" is", ".\nis"), "en" if i % 3 else "de"])
    long = " ".join(r.choice(EN) + str(r.randint(0, 99)) for _ in range(9000))
    rows += [[1000, None, "en"], [1001, "", "en"], [1002, "", None], [1003, "one two", "en"], [1004, long, "en"], [1005, "mail a.b@c-d.org or +1 (988) 555-2485, card 4111 1111 1111 1111 at 10.0.0.255!", "en"], [1006, rows[5][1], "en"], [1007, rows[5][1], "en"], [7, rows[7][1], "en"], [1008, long + " more", "en"], [1009, "日本語 und ½ ² 'S I'LL \x1c <|endoftext|> é", "de"]]
    return [(a, b, c, "src0", None if b is None else len(b), 1, "clash") for a, b, c in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(plain_ids, "t"):
        plain_ids.t = Tokenizer.from_file(tokens.tokenizer_file())
    return plain_ids.t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_ids_are_the_librarys():
    r = random.Random(4)
    odd = ["".join(r.choice("ab 'stdl.é½²\xa0\x85\xadªÉ3!\x1f") for _ in range(40)) for _ in range(300)]
    texts = [*odd, "ΣΑΣ İstanbul", "한국어 中文 ​", "<|startoftext|>x", "", "a\x00b"]
    got = tokens.WordIds(tokens.tokenizer_file())(texts)
    assert [g.tolist() for g in got] == [plain_ids(t) for t in texts]


def test_word_ids_look_up_distinct_chunks_alone():
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return dict.get(self, key, default)

    encoder = tokens.WordIds(tokens.tokenizer_file())
    encoder.known = Counted()
    texts = ["The cat,\xa0the Été\x85the cat  " * 500, "", " \n", "the CAT, ÉTÉ", "x <|endoftext|> y", "λόγος the"] * 20
    for _ in range(2):
        Counted.asked = 0
        got = encoder(texts)
        assert Counted.asked < 100  # of 60,000 words
    assert [g.tolist() for g in got] == [plain_ids(t) for t in texts]


def test_a_worker_keeps_few_bytes_a_chunk():
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}a\xe9{j}" for i in range(5000)) for j in range(2)] + ["a\0b a\0 a", "x" * 40 + " a"]
    encoder = tokens.WordIds(tokens.tokenizer_file())
    for _ in range(2):
        assert [g.tolist() for g in encoder(texts)] == [plain_ids(t) for t in texts]
    assert not encoder.known  # no Python object for a Latin-1 chunk
    kept = [encoder.chunks, encoder.hashes, encoder.places, encoder.starts, encoder.lengths, encoder.flat]
    assert 10_000 < len(encoder.chunks) < 10_010 and sum(x.nbytes for x in kept) < 64 * len(encoder.chunks)


def test_texts_come_in_batches_of_few_rows(spark):
    common.small_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500


def test_plan_fills_and_is_near_the_bound():
    r = random.Random(2)
    h = collections.Counter(min(64, max(1, int(r.expovariate(1 / 20)))) for _ in range(5000))
    used = collections.defaultdict(list)
    for length, _, slots, first, each, offset in packing.plan(h, 64):
        for k in range(slots):
            used[first + k // each].append((offset + k % each * length, length))
    assert sum(map(len, used.values())) == sum(h.values())
    for v in used.values():
        v.sort()
        assert v[0][0] == 0 and v[-1][0] + v[-1][1] <= 64 and all(a + b == c for (a, b), (c, _) in zip(v, v[1:]))
    assert len(used) <= math.ceil(sum(k * v for k, v in h.items()) / 64) + 3
    assert packing.plan({}, 64) == []


def test_op1(docs, empty):
    rows = packing.pack_documents(docs).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = plain_ids(r.text) + [0]
        for p in range(0, len(ids), 2048):
            want[r.doc_id, p // 2048, p, len(ids[p : p + 2048]), crc(ids[p : p + 2048])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        v.sort()
        assert v[0][0] == 0 and sum(n for _, n in v) <= 2048 and all(a + b == c for (a, b), (c, _) in zip(v, v[1:]))
    whole = packing.pack(docs, 512)
    made = packing.sequences(whole).collect()
    assert sum(len(r.ids) for r in made) == sum(k[3] * v for k, v in want.items()) and max(len(r.ids) for r in made) <= 512
    assert packing.pack_documents(empty).count() == 0


def test_op2(spark, docs, empty):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(EN) + r.choice(["", "a", "b", "c"]) for _ in range(80)]
        grade = r.choice([0, 1, 2, 2, 2])
        if grade == 0:
            words = [w + "!!" for w in words]
        if grade == 1:
            for k in r.sample(range(80), 3):
                words[k] = r.choice(["vileword", "nastyword"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(grade > 0), int(grade == 1)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    held = spark.createDataFrame(labels[:250] + [(1, None, None), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.classify_documents(d, held).collect()}
    right = [got[i].selected == bool(q and not t) for i, q, t in labels[250:]]
    assert len(got) == 400 and sum(right) / len(right) > 0.95
    assert all(0 <= x.tail_prob <= 1 and 0 <= x.expected_grade <= 2 for x in got.values())
    assert quality.classify_documents(empty, held).count() == 0
    kept = quality.select_documents(docs, held.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def brute_classes(rows):
    table = Words()
    bags = {}
    for r in rows:
        bags.setdefault(r.text or "", bag(r.text or "", table))
    texts = list(bags)
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if len(bags[a][0]) and len(bags[b][0]) and overlap(bags[a], bags[b]) >= 0.8:
                parent[find(a)] = find(b)
    least = {}
    for r in rows:
        k = find(r.text or "")
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    return collections.Counter((r.doc_id, least[find(r.text or "")]) for r in rows)


def test_capitals_of_long_texts_are_counted_over_all_words():
    for line in ("LOUD low", "low LOUD"):  # lines whose period divides a stride of two words
        chunks = (line + " ") * 2000
        assert quality._bucket("s capitals 4") in quality.shares(chunks, chunks.split(), 2)


def test_signatures_are_unbiased():
    r = random.Random(2)
    table, miss = Words(), []
    for k in range(30):
        base = [f"w{r.randint(0, 500)}" for _ in range(200)] + ["rep"] * r.randint(0, 60)
        other = list(base)
        for _ in range(r.randint(1, 25)):
            other[r.randrange(len(other))] = "zz"
        other += ["rep"] * (k % 3 * 15)
        a, b = bag(" ".join(base), table), bag(" ".join(other), table)
        s = bagminhash.signatures([a, b], 320)
        miss.append(float((s[0] == s[1]).mean()) - overlap(a, b))
    assert abs(np.mean(miss)) < 0.02 and np.std(miss) < 0.05
    many = [bag(" ".join(f"w{r.randint(0, 50)}" for _ in range(r.choice([6, 30, 3000]))), table) for _ in range(12)]
    assert (np.vstack([bagminhash.signatures([b], 320) for b in many]) == bagminhash.signatures(many, 320)).all()


def test_op3(spark, docs, empty):
    r = random.Random(8)
    base = [r.choice(EN) + str(r.randint(0, 50)) for _ in range(120)]
    rows = [tuple(x) for x in docs.select("doc_id", "text").collect()]
    for i in range(60):  # a group whose members are often, but not always, near
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(120)] = f"e{r.randint(0, 9)}"
        rows.append((2000 + i, " ".join(words)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = bagminhash.classes_of(d).collect()
    assert collections.Counter((x.doc_id, x.class_id) for x in got) == brute_classes(d.collect())
    assert bagminhash.classes_of(empty).count() == 0
    one = bagminhash.one_of_each(docs)
    kept = one.collect()
    assert one.columns == docs.columns
    assert sorted(x.doc_id for x in kept) == sorted({c for _, c in brute_classes(docs.collect())})


def test_op4(spark):
    big, small = "<p>" + "x" * 1500 + "é</p>", "tiny"
    rows = [(1, "http://a/1", big), (2, "http://a/2 \r\n", big), (3, None, big), (4, "http://a/4", small), (5, "http://a/5", small), (6, "http://b", None), (None, "http://c", big), (7, "http://d", "y" * 999), (8, "http://d", "y" * 999), (9, "http://e", "q" * 1000), (10, "http://e", "q" * 1000), (3, "http://z", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.archive_pages(pages).collect()
    by = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert by == collections.Counter([(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (3, "revisit", 3), (4, "response", None), (5, "response", None), (6, "response", None), (None, "response", None), (7, "response", None), (8, "response", None), (9, "revisit", 10), (10, "response", None)])
    html = {(p, u): (h or "").encode() for p, u, h in rows}
    for r in got:
        assert r.payload_digest == hashlib.sha1(html[r.page_id, r.url]).hexdigest() and r.payload_bytes == len(html[r.page_id, r.url])
    index = warc.write_archives(pages)
    some = warc.read_records(index.where("page_id in (4, 6)")).collect()
    assert {(r.page_id, bytes(r.payload)) for r in some} == {(4, b"tiny"), (6, b"")}
    assert warc.archive_pages(pages.limit(0)).count() == 0
    assert [(a, b) for a, b, _ in warc.ranges([0, 10, 500_000], [10, 5, 7])] == [(0, 15), (500_000, 500_007)]


def test_op5(docs, empty):
    got = {(r.doc_id, r.held_out): r for r in langid.identify_documents(docs).collect()}
    for (i, held), r in got.items():
        assert held == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    right = [got[r.doc_id, h].lang_pred == r.lang for r in docs.collect() for h in (True,) if (r.doc_id, h) in got and r.doc_id < 1000 and len(r.text) > 40]
    assert len(right) > 10 and sum(right) / len(right) > 0.9
    assert all(got[i, zlib.crc32(str(i).encode()) % 4 == 2].lang_pred == "und" for i in (1000, 1001))
    assert langid.identify_documents(empty).count() == 0
    assert {r.lang_pred for r in langid.identify_documents(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_op6(spark, docs, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    near = item.replace("mu", "MU,").replace("upsilon", "changed")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short item"), (5, item)], "item_id long, text string")
    d = spark.createDataFrame([(1, "pre text " + item.upper() + " post"), (2, near), (3, item.replace("kappa", "other")), (4, "a short item here"), (5, None), (6, "nothing of it"), (None, item)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(d, bench).collect()}
    assert set(got) == {(1, 1), (1, 5), (2, 1), (2, 5), (4, 4), (None, 1), (None, 5)}
    assert got[1, 1].similarity == 1 and got[1, 1].start == 9 and got[1, 1].first_word == 2
    assert 0.8 <= got[2, 1].similarity < 1
    assert {r.doc_id for r in decontam.without_contaminated(d, bench).collect()} == {3, 5, 6}
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(empty, bench).count() == 0


def test_documents_shorter_than_an_item_are_compared_whole(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "one two three")], "item_id long, text string")
    cut = {k: " ".join(words[a:z]) for k, (a, z) in {1: (0, 18), 2: (2, 20), 3: (1, 19), 4: (0, 16), 5: (3, 20), 6: (0, 4)}.items()}
    d = spark.createDataFrame([*cut.items(), (7, "one two"), (8, cut[1].upper() + "!")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated(d, bench).collect()}
    assert set(got) == {1, 2, 3, 5, 8}  # 14, 14, 14, 13 and 14 of the item's 16 shingles; 4 has 12
    assert all(r.item_id == 1 and r.similarity == (13 if k == 5 else 14) / 16 for k, r in got.items())
    assert [(r.first_word, r.n_words, r.start, r.end) for r in (got[1], got[5])] == [(0, 18, 0, len(cut[1])), (0, 17, 0, len(cut[5]))]
    assert {r.doc_id for r in decontam.without_contaminated(d, bench).collect()} == {4, 6, 7}


def test_clean_documents_with_null_or_repeated_ids_stay(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = spark.createDataFrame([(None, item), (None, "clean a"), (None, None), (1, item), (1, "clean b"), (1, None), (2, item), (2, item), (3, "clean c"), (3, "clean c")], "doc_id long, text string")
    got = decontam.without_contaminated(d, bench)
    assert got.columns == d.columns and decontam.contaminated(d, bench).columns[:2] == ["doc_id", "item_id"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(None, "clean a"), (None, None), (1, "clean b"), (1, None), (3, "clean c"), (3, "clean c")]))


def test_hamming_blocks_find_all_within_the_radius():
    items = decontam.Items([(1, "alpha beta gamma delta epsilon zeta eta")], Words())
    r = random.Random(1)
    for _ in range(300):
        p = items.prints[0]
        d = r.randint(0, 30)
        for b in r.sample(range(64), d):
            p ^= 1 << b
        assert bool(items.candidates(p, 7)) == (d <= decontam.RADIUS)


def test_op7(spark, docs, empty):
    got = merkle.fingerprint_documents(docs).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id, r.text or ""))
    texts = [r.text or "" for r in rows]
    want = collections.Counter()
    for i, r in enumerate(rows):
        t, after = texts[i], texts[(i + 1) % len(rows)]
        half = len(t) // 2
        want[r.doc_id, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    roots = collections.defaultdict(set)
    for r in got:
        roots[r.fingerprint.split("/")[0]].add(next(t or "" for i, t in zip([x.doc_id for x in rows], texts) if i == r.doc_id))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(t) == 1 for t in roots.values())
    mean = lambda f: sum(f(r) for r in got) / len(got)
    assert mean(lambda r: r.near_edited) > mean(lambda r: r.near_next) + 0.2
    assert merkle.fingerprint_documents(empty).count() == 0
    single = merkle.fingerprint_documents(spark.createDataFrame([(None, "ab\ncd")], "doc_id long, text string")).collect()
    assert single[0].near_next == 1.0 and single[0].edited_sha256 == hashlib.sha256(b"ab\nab").hexdigest()
    pair = spark.createDataFrame([("a\nb.c\nd", "a\nb.x\nd")], "x string, y string")
    both = merkle.fingerprint(merkle.fingerprint(pair, "x", "fx"), "y", "fy")
    assert both.select(merkle.locate(F.col("fx"), F.col("fy"), 3)).first()[0] == 1


def draw(key, level, children):
    def u(child):
        h = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(level.encode(), h)
        h = xxhash.xxh64_intdigest(int(child).to_bytes(4, "little", signed=True), h)
        return ((h & ((1 << 53) - 1)) + 0.5) / (1 << 53)

    return min((-math.log(u(c)) / w, c) for c, w in children.items())[1]


def test_op8(docs, empty):
    got = sharding.shard_documents(docs, 40).collect()
    regions, racks, shards = sharding.Topology.balanced(40).children()
    for r in got[:60]:
        region = draw(r.doc_id, "region", regions)
        rack = draw(r.doc_id, "rack", racks[region])
        assert (r.region, r.rack, r.shard) == (region, rack, draw(r.doc_id, "shard", shards[rack]))
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got)
    assert sharding.shard_documents(empty, 40).count() == 0


def test_weights_move_rows_only_into_heavier_shards(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    old = sharding.Topology.balanced(8)
    heavier = sharding.Topology(tuple(sharding.Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 3 else 1.0) for x in old.leaves))
    both = ids.select(sharding.place(F.col("doc_id"), old).alias("a"), sharding.place(F.col("doc_id"), heavier).alias("b")).collect()
    assert all(r.b.rack == 1 for r in both if r.a.rack != r.b.rack)
    assert 0.17 < sum(r.b.shard == 3 for r in both) / len(both) < 0.28


def test_op9(docs, empty):
    import re

    fixed = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]

    def brute(text):
        out = []
        for k, p in enumerate(fixed):
            for m in p.finditer(text):
                digits = re.sub("[^0-9]", "", m[0])
                if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits))) or (k == 3 and not 10 <= len(digits) <= 15):
                    continue
                out.append((m.start(), k, m.end()))
        return sorted(out)

    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice(["a", "b.", "@", "-", "_", "1", "23", "4.", "255", ".", "+1", " ", "(", "%", "é", "1.2.3.4", "4111111111111111"]) for _ in range(r.randint(1, 25)))
        assert pii.base_spans(t) == brute(t)
    got = {x.doc_id: x for x in pii.find_in_documents(docs).collect()}
    for x in docs.collect():
        base = brute(x.text or "")
        assert got[x.doc_id].base_sha256 == hashlib.sha256(pii.render(base).encode()).hexdigest()
        assert set(pii.render(base).split(",")) <= set(got[x.doc_id].spans.split(","))
    x = got[1005]
    assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == (1, 1, 1, 1)
    masked = pii.masked_documents(docs)
    assert masked.columns == docs.columns
    assert next(m.text for m in masked.collect() if m.doc_id == 1005).startswith("mail [EMAIL] or [PHONE]")
    assert pii.find_in_documents(empty).count() == 0


def test_skip_edges_carry_a_label_to_a_distant_mention():
    texts = [f"call +1 ({200 + i}) 555-{1000 + i} now" for i in range(60)] + [f"order {1000000 + i * 37} of {i} parts" for i in range(60)]
    samples = []
    for t in texts:
        spans, features, keys = pii.words_of(t)
        near, far = pii.edges_of(t, spans, keys)
        samples.append((features, near, far, pii.gold(spans, pii.base_spans(t))))
    model = pii.fit(samples)
    text = "call +1 (988) 555-2485 now. " + "words and more words " * 50 + "again 555-2485 there"
    base = pii.base_spans(text)
    spans, features, keys = pii.words_of(text)
    near, far = pii.edges_of(text, spans, keys)
    assert far
    with_skip = pii.marginals(model, features, near, far)[-1, 4]
    assert with_skip > pii.marginals(model, features, near, [])[-1, 4]
    assert all(a >= e or b <= s for s, _, e in base for a, _, b in pii.added_spans(text, base, model))


def test_codec_round_trip_and_checksums():
    r = np.random.default_rng(0)
    parts = [r.integers(0, 65536, 5000).astype(np.uint16), np.zeros(9000, np.uint16), np.zeros(0, np.uint16), np.tile(np.arange(7, dtype=np.uint16), 2000), np.array([65535], np.uint16)]
    raw = idcodec.pack_file([3, None, 5, 6, 7], parts)
    back = list(idcodec.unpack_file(raw))
    assert [d for d, _ in back] == [3, None, 5, 6, 7] and all((a == b).all() for a, (_, b) in zip(parts, back))
    assert len(raw) < 2 * sum(map(len, parts)) * 0.6
    spoilt = bytearray(raw)
    spoilt[-3] ^= 255
    with pytest.raises(ValueError):
        list(idcodec.unpack_file(bytes(spoilt)))
    assert list(idcodec.unpack_file(idcodec.pack_file([], []))) == []


def test_op10(docs, empty):
    got = idfiles.documents_ids(docs).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id, r.text or ""))
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = plain_ids(r.text) + [1]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), crc(ids))
        start += len(ids)
    assert idfiles.documents_ids(empty).count() == 0


def test_ranks_are_gapless_in_a_hot_key(spark):
    d = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    got = rank_within(d, ["k"], ["id"], F.pmod(F.xxhash64("id"), F.lit(16))).where("k = 'hot'").collect()
    assert sorted(r["rank"] for r in got) == list(range(1000))


def test_samples_are_bounded_and_repeatable(spark):
    d = spark.range(20_000)
    got = {r.id for r in bounded_sample(d, F.xxhash64("id"), 500, 20_000).collect()}
    assert len(got) == 500 and got == {r.id for r in bounded_sample(d.repartition(7), F.xxhash64("id"), 500, 20_000).collect()}


def test_samples_are_full_however_few_rows_are_eligible(spark):
    d = spark.range(200_000).where("id % 1000 = 7")
    for n in (1, 150, 1000):
        got = bounded_sample(d, F.xxhash64("id"), n, 200_000).collect()
        assert len({r.id for r in got}) == len(got) == min(n, 200)
    same = spark.range(5000).select(F.when(F.col("id") < 4900, F.lit(1)).otherwise(F.col("id")).alias("id"))  # one row many times
    assert bounded_sample(same, F.xxhash64("id"), 100, 5000).count() == 100
    few = spark.range(4000).select("id", F.concat_ws(" ", F.lit("the thing and of"), F.col("id")).alias("text"), F.when(F.col("id") % 100 == 3, F.lit("en")).alias("lang"), F.col("id").alias("doc_id"))
    assert langid.train(few, F.lit(True), sample=20)["names"] == ["en"]
    assert pii.train(few.withColumn("text", F.when(F.col("id") % 1000 == 1, F.lit("call +1 988 555 2485")).otherwise("no such")), sample=20) is not None


def test_one_row_of_a_class_is_kept(spark):
    text = " ".join(EN * 3)
    rows = [(1, text), (1, text), (2, text + " more"), (2, text + " more"), (None, text), (None, "only null"), (None, "only null"), (5, None), (6, ""), (5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = bagminhash.classes_of(d).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in got) == collections.Counter([(1, 1, 5)] * 2 + [(2, 1, 5)] * 2 + [(None, 1, 5)] + [(None, None, 2)] * 2 + [(5, 5, 3)] * 2 + [(6, 5, 3)])
    assert sorted((r.doc_id is None, r.doc_id) for r in got if r.kept) == [(False, 1), (False, 5), (True, None)]
    assert len(bagminhash.one_of_each(d).collect()) == 3


def test_open_pairs_lose_no_link(spark):
    """Sets around a pivot: every link between components of which not both ends are like the pivot comes out."""
    r = random.Random(4)
    base = list(range(100))
    sets = {0: frozenset(base)}
    for i in range(1, 90):
        of = sets[r.choice([0, *range(max(1, i - 8), i)])]
        sets[i] = frozenset(x for x in of if r.random() > 0.07) | {r.randrange(100, 160) for _ in range(r.randint(0, 9))}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    comp = {i: -1 if like(0, i) else i for i in sets}
    apart = common.stage(spark.createDataFrame([(0, i, 100, len(sets[i]), sorted(sets[0] ^ sets[i])) for i in range(1, 90)], "a long, b long, p long, n long, d array<long>"), "apart")
    labels = spark.createDataFrame([(i, c) for i, c in comp.items() if c < 0], "node long, comp long")
    got = {frozenset((x.a, x.b)) for x in bagminhash.open_pairs(apart, labels).collect()}
    want = {frozenset((i, j)) for i in range(1, 90) for j in range(1, i) if comp[i] != comp[j] and like(i, j)}
    assert len(want) > 20 and want <= got
    assert len(got) < 89 * 88 / 4


def test_bags_as_sets_keep_the_similarity():
    r = random.Random(6)
    for _ in range(50):
        a, b = (bag(" ".join(r.choice("xyz") for _ in range(r.randint(1, 60))), Words()) for _ in range(2))
        x, y = set(bagminhash.single(a).tolist()), set(bagminhash.single(b).tolist())
        assert len(x) == a[1].sum() and abs(len(x & y) / len(x | y) - overlap(a, b)) < 1e-12


def brute_matches(text, items):
    """The best similarity of each item over all windows of its length, or the whole of a shorter document."""
    table, out = Words(), {}
    from tidelog.llm.shingles import hashes, shingles

    words = decontam.WORD.findall(text.lower())
    for k, item in items:
        mine = decontam.WORD.findall((item or "").lower())
        if not mine or not words:
            continue
        width = min(5, len(mine))
        if len(words) < width:
            continue
        of = lambda x: np.unique(shingles(hashes(x, table), width), return_counts=True)
        n = min(len(mine), len(words))
        best = max(overlap(of(words[p : p + n]), of(mine)) for p in range(len(words) - n + 1))
        if best >= 0.8:
            out[k] = best
    return out


def test_op6_against_all_windows(spark):
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 8, 20, 20, 45])))) for i in range(40)] + [(40, None), (41, ""), (7, "w1 w2 w1 w2 w1 w2 w1 w2 w1 w2")]
    docs = []
    for i in range(90):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 4, 15, 60, 200]))]
        for _ in range(r.randint(0, 3)):
            item = (r.choice(items)[1] or "").split()
            if item and r.random() < 0.3:
                item[r.choice([0, -1, r.randrange(len(item))])] = r.choice(vocabulary)
            at = r.randint(0, len(words))
            words[at:at] = item[r.randint(0, 1) : len(item) - r.randint(0, 1)]
        docs.append((i, " ".join(words)))
    docs += [(90, "w1 w2 " * 3000), (91, None), (None, docs[3][1]), (3, docs[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit("clash"), "similarity": F.lit(None).cast("string"), "hits": F.lit(1)})
    got = collections.Counter((x.doc_id, x.item_id, round(x.similarity, 9)) for x in decontam.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect())
    want = collections.Counter((i, k, round(v, 9)) for i, t in docs for k, v in brute_matches(t or "", items).items())
    assert len(want) > 30 and got == want
    many = decontam.Items([(i, t or "") for i, t in items], Words())
    assert len(many.ids) == 41


def test_a_fitted_classifier_on_odd_rows(spark, docs):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(EN) for _ in range(60)) + (" vileword" if i % 4 == 1 else "") + ("!!" * 40 if i % 4 == 2 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 != 2), int(i % 4 == 1)) for i in range(200)], "doc_id long, quality int, toxic int")
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    odd = docs.withColumns({"expected_grade": F.lit("clash"), "tail_prob": F.lit("clash")})
    got = quality.score(odd, model, keep=["doc_id", "text"]).collect()
    assert len(got) == docs.count() and all(0 <= x.tail_prob <= 1 for x in got)
    by = collections.defaultdict(set)
    for x in got:
        by[x.text or ""].add((x.expected_grade, x.tail_prob, x.selected))
    assert all(len(v) == 1 for v in by.values())
    kept = quality.select_documents(odd, labels)
    assert kept.columns == odd.columns
    wholly = quality.features("clean " * 30_000 + "vileword", quality.Chunks())
    assert quality._bucket("w vileword") in wholly and len(quality.features("", quality.Chunks())) == 4


def test_long_texts_score_alike_in_one_run_or_many(monkeypatch):
    text = "".join(random.Random(1).choice("ab ç\u4e2d1.  ") for _ in range(5000))
    whole = langid.counted(text)
    for n in (4, 7, 100, 4999):
        monkeypatch.setattr(langid, "RUN_BYTES", n)
        again = langid.counted(text)
        assert all((a == b).all() for a, b in zip(whole, again, strict=True))


def test_marginals_are_exact_on_a_tree_and_close_on_a_loop():
    import itertools

    r = np.random.default_rng(1)
    n = len(pii.NAMES) + 1
    model = {"w": r.normal(0, 1, (pii.BUCKETS, n)).astype(np.float32), "near": r.normal(0, 0.5, (n, n)), "far": np.eye(n) * 0.8}
    features = [r.integers(0, pii.BUCKETS, pii.FEATURES).tolist() for _ in range(4)]

    def exact(near, far, known):
        total = np.zeros((4, n))
        for y in itertools.product(range(n), repeat=4):
            if any(k and k != v for k, v in zip(known, y, strict=True)):
                continue
            e = sum(model["w"][f].sum(0)[v] for f, v in zip(features, y, strict=True)) + sum(model["near"][y[a], y[b]] for a, b in near) + sum(model["far"][y[a], y[b]] for a, b in far)
            for i, v in enumerate(y):
                total[i, v] += np.exp(e)
        return total / total.sum(1, keepdims=True)

    for near, far, most in (([(0, 1), (1, 2)], [(1, 3)], 1e-3), ([(0, 1), (1, 2), (2, 3)], [(0, 3)], 0.1)):
        for known in ([0, 0, 0, 0], [2, 0, 0, 0]):
            assert np.abs(pii.marginals(model, features, near, far, known) - exact(near, far, known)).max() < most


def test_the_field_finds_hidden_mentions():
    r = random.Random(9)
    word = lambda: r.choice(EN) + r.choice(["", "ing", "ed"])

    def document():
        words = [word() for _ in range(40)]
        card = [r.randint(0, 9) for _ in range(15)]
        card = next("".join(map(str, [*card, k])) for k in range(10) if pii.luhn("".join(map(str, [*card, k]))))
        made = [f"{word()}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.org", ".".join(str(r.randint(1, 255)) for _ in range(4)), card, f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}", f'token = "{r.getrandbits(160):040x}"', "version 4.0.", f"in {r.randint(1900, 2030)}", str(r.randint(10, 99999)), f"{r.getrandbits(52) % 10**15:015d}7"]
        for x in r.sample(made, 4):
            words.insert(r.randint(0, len(words)), x)
        return " ".join(words)

    model = pii.fit([pii.example(document()) for _ in range(400)])
    found = missed = false = 0
    for _ in range(200):
        text = document()
        base = pii.base_spans(text)
        other, known = pii.hidden(text, sorted([*base, *pii.secrets(text)]))
        left = pii.base_spans(other)
        added = pii.added_spans(other, left, model)
        for a, k, b in known:
            if not any(x < b and y > a for x, _, y in left):
                hit = any(x < b and y > a and j == k for x, j, y in added)
                found, missed = found + hit, missed + (not hit)
        false += sum(not any(x < b and y > a for a, _, b in known) for x, _, y in added)
        assert all(y <= a or x >= b for x, _, y in added for a, _, b in left)
    assert found > 100 and found / (found + missed) > 0.9 and false / (found + false) < 0.05
    assert pii.words_of("9" * 5000 + "x" * 300 + "1234567")[2] == ["d1234567"]


SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
def test_codec_takes_fewer_bits_than_zlib_and_the_static_order_0():
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table(SF, columns=["text"]).column("text").to_pylist()]
    parts = [np.append(x, np.uint16(1)) for x in tokens.WordIds(tokens.tokenizer_file())(texts)]
    raw = idcodec.pack_file(list(range(len(parts))), parts)
    assert all((a == b).all() for a, (_, b) in zip(parts, idcodec.unpack_file(raw), strict=True))
    ids = np.concatenate(parts)
    blocks = sum(len(zlib.compress(ids[i : i + 2048].astype("<u2").tobytes(), 6)) for i in range(0, len(ids), 2048))
    whole = len(zlib.compress(ids.astype("<u2").tobytes(), 6))
    p = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert len(raw) < 0.75 * blocks and len(raw) < 0.85 * whole and len(raw) * 8 < -(p * np.log2(p)).sum() * len(ids)
    one = idcodec.Counts.unpack(idcodec.Counts.of(ids).pack())
    block = ids[None, : idcodec.BLOCK]
    assert (idcodec.decode_blocks(idcodec.encode_blocks(block, one), one) == block).all()  # a block by itself


def test_a_task_writes_several_files(docs):
    d = docs.coalesce(1)
    index = idfiles.write_ids(d, file_ids=2000)
    assert index.count() > 8 and index.groupBy("part").count().agg(F.max("count")).first()[0] > 2
    got = idfiles.read_ids(index).orderBy("start").collect()
    want = sorted(docs.collect(), key=lambda r: (r.doc_id, r.text or ""))
    start = 0
    for r, g in zip(want, got, strict=True):
        assert (g.doc_id, g.start, g.ids) == (r.doc_id, start, plain_ids(r.text) + [1])
        start += g.n_tokens


def test_slots_of_null_and_tied_ids(spark):
    rows = [(None, "a"), (None, "b"), (None, None), (4, "x"), (4, "x"), (4, "yy"), (5, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit(9), "slot": F.lit("clash")})
    a, b = (sorted(map(str, map(tuple, sharding.shard_documents(x, 40).collect()))) for x in (d, d.repartition(5)))
    assert a == b and len(a) == len(rows)


def test_staged_tables_have_owners(spark):
    with common.owner("one"):
        mine = common.stage(spark.range(3), "mine")
    other = common.stage(spark.range(4), "other")
    assert mine.count() == 3
    common.release(spark, "one")
    assert other.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FAILED_READ|does not exist"):
        spark.read.parquet(mine.staged_at).count()
    common.discard(other)


def test_a_pipeline_run_leaves_other_results(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(2)
    rows = make(60)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, r.choice([1, 1, 0]), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[9][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = bagminhash.classes_of(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert pipeline.run(spark, str(tmp_path)).columns[:2] == ["doc_id", "piece"]
    assert before.count() == len(rows)
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    empty = at.limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == at.columns)
