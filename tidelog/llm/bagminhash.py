"""Near-duplicate classes by BagMinHash signatures, banding and exact verification.

A text is a bag of five-word shingles with counts. The axis of a shingle's weight is cut at 0, 1,
2, 4, 8, ...; each cell carries a Poisson process whose points have a time, a place in the cell
and a signature position, all hashed from shingle and cell. A signature position keeps the least
time of the points below the shingle's count, so two signatures agree at a position with the
chance of the bags' weighted Jaccard similarity. Points come in order of time and a text stops
once they are later than all it keeps, which takes few points a shingle.

Equal texts form one node first. Signatures are cut into bands, nodes that share a band are
candidates, and candidates are verified on their whole texts. A bucket is not expanded: its most
linked member, the pivot, is verified against the others and components are formed, twice. What is
open then, pairs of different components in one bucket, is found by the members' differences from
the bucket's pivot: two texts of the asked similarity that are not both like the pivot must share
much of what sets them apart from it. So only the rarest of these shingles are joined (prefix
filtering), instead of the bucket with itself. In the end every pair that shares a band is in one
component, verified, or ruled out.

Edge cases: texts of less than five words are one shingle of all their words; null and empty texts
are equal to each other and to nothing else; texts of any length are read whole; repeated rows are
equal texts, of which one is kept; null ids take part and name a class only if it has no other id;
ties go to the least id; extra columns do not matter, whatever their names; an empty table gives no
row. Nodes are 64-bit text hashes: two different texts in n share one with a chance of about
n*n / 2**65.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, small_side, stage, text_of, worker_cache
from .shingles import GOLD, Words, bag, mix, overlap
from .textpass import add_columns

SIMILARITY = 0.8
BANDS = 40
ROWS = 8
STARS = 2
#: Parts that the pairs of one pivot are dealt to, and rows that one task makes of a repeated row at once.
PIVOT_PARTS, RUN = 256, 4096


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """(texts, size) least times; inf throughout for an empty bag."""
    element = np.concatenate([b[0] for b in bags]) if bags else np.zeros(0, np.uint64)
    count = np.concatenate([b[1] for b in bags]).astype(np.int64) if bags else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    low, cells = 0, []
    while len(element):
        high = max(1, 2 * low)
        cells.append((mix(element ^ np.uint64(len(cells) * 0x9E3779B9)), text, count, np.full(len(element), low), np.full(len(element), high - low)))
        more = count > high
        element, text, count, low = element[more], text[more], count[more], high
    out = np.full(len(bags) * size, np.inf)
    if not cells:
        return out.reshape(len(bags), size)
    seed, text, count, start, width = (np.concatenate(x) for x in zip(*cells, strict=True))
    time, step = np.zeros(len(seed)), 0
    latest = np.full(len(bags), np.inf)
    while len(seed):
        k = int(np.clip(8192 // len(seed), 1, 64))  # points of each cell in this round
        at = np.arange(step + 1, step + 1 + k, dtype=np.uint64) * GOLD
        r = mix(seed[:, None] + at)
        waits = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
        # added one by one from the time so far, so that no sum depends on how many points a round has
        times = np.cumsum(np.column_stack((time, waits)), axis=1)[:, 1:]
        r = mix(r + GOLD)
        place = start[:, None] + (((r >> np.uint64(32)) * width[:, None].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        position = (((r & np.uint64(0xFFFFFFFF)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
        hit = (times < latest[text][:, None]) & (place < count[:, None])
        np.minimum.at(out, (text[:, None] * size + position)[hit], times[hit])
        time, step = times[:, -1], step + k
        some = np.unique(text)
        latest[some] = out.reshape(len(bags), size)[some].max(1)
        on = time < latest[text]
        seed, text, count, start, width, time = seed[on], text[on], count[on], start[on], width[on], time[on]
    return out.reshape(len(bags), size)


def bands_of(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each text."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLD, bits.shape[:2]).copy()
    for j in range(rows):
        key = mix(key ^ bits[:, :, j]) + GOLD
    return key.view(np.int64)


def banded(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node and band keys of every document; empty texts have no band."""

    def make() -> Callable:
        table = worker_cache("words", Words)

        def run(texts: list[str]) -> list[pa.Array]:
            out: list = [None] * len(texts)
            at, room, held = 0, 0, []
            for i, t in enumerate(texts):
                held.append(bag(t, table))
                room += len(held[-1][0])
                if room >= 60_000 or i == len(texts) - 1:
                    keys = bands_of(signatures(held, bands * rows), bands, rows)
                    for j, b in enumerate(held):
                        out[at + j] = keys[j] if len(b[0]) else []
                    at, room, held = i + 1, 0, []
            return [pa.array(out, pa.list_(pa.int64()))]

        return run

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("node", F.xxhash64("text"))
    return add_columns(rows_, make, "bands array<bigint>", keep=["doc_id", "node"])


def _beside(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with both texts in one column. ``pairs`` is staged; a pivot's pairs are dealt to many tasks."""
    part = F.pmod(F.xxhash64("b"), F.lit(PIVOT_PARTS))
    few = small_side(pairs)
    right = texts.join(few, texts["node"] == few["b"]).select("a", "b", part.alias("part"), F.col("text").alias("tb"))
    pivots = small_side(pairs.select(F.col("a").alias("node"), part.alias("part")).distinct())
    left = texts.join(pivots, "node").select(F.col("node").alias("a"), "part", F.col("text").alias("ta"))
    return right.join(left, ["a", "part"]).select("a", "b", F.concat(F.char_length("ta").cast("string"), F.lit(" "), "ta", "tb").alias("text"))


def _bags_of_both(of: Callable) -> Callable:
    """Calls ``of`` with both bags of each row of ``_beside``; recent bags are kept, as a pivot comes often."""

    def make() -> Callable:
        table, kept = worker_cache("words", Words), OrderedDict()

        def bag_of(text: str):
            if text not in kept:
                kept[text] = bag(text, table)
                if len(kept) > 16:
                    kept.popitem(last=False)
            else:
                kept.move_to_end(text)
            return kept[text]

        def run(both: list[str]) -> list[pa.Array]:
            rows = []
            for x in both:
                n, _, rest = x.partition(" ")
                rows.append((bag_of(rest[: int(n)]), bag_of(rest[int(n) :])))
            return of(rows)

        return run

    return make


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with the similarity of their whole texts. ``pairs`` is staged."""
    of = _bags_of_both(lambda rows: [pa.array([overlap(x, y) for x, y in rows], pa.float64())])
    return add_columns(_beside(pairs, texts), of, "similarity double", keep=["a", "b"])


def single(of: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The bag as a set: a shingle's further occurrences are elements of their own."""
    h, c = of
    if not len(h) or c.max() == 1:
        return h
    nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
    every = np.repeat(h, c)
    return np.where(nth > 0, mix(every + nth.astype(np.uint64) * GOLD), every)


def differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with p and n, the sizes of both bags, and d, what only one of them has."""

    def of(rows: list) -> list[pa.Array]:
        sets = [(single(x), single(y)) for x, y in rows]
        apart = [np.setxor1d(x, y).view(np.int64) for x, y in sets]
        return [pa.array([len(x) for x, _ in sets], pa.int64()), pa.array([len(y) for _, y in sets], pa.int64()), pa.array(apart, pa.list_(pa.int64()))]

    return add_columns(_beside(pairs, texts), _bags_of_both(of), "p bigint, n bigint, d array<bigint>", keep=["a", "b"])


def open_pairs(apart: DataFrame, labels: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs of different components that may have the similarity, by their differences from a pivot they share.

    Sets x and y are similar enough if at most ``part * (|x| + |y|)`` elements are in one only, with
    ``part = (1 - s) / (1 + s)``. These are what their differences from the pivot do not share, so the
    differences must share ``(|dx| + |dy| - part * (|x| + |y|)) / 2``. If x is not like the pivot, |dx| is
    more than ``part * (|x| + |pivot|)``, which leaves a bound for y by itself: ``(|dy| + part * (|pivot|
    - |y|)) / 2``. Of differences in order of rarity, then, y's first ``|dy| - bound + 1`` hold a shared one;
    it is among x's first ones if neither is like the pivot, and anywhere in x's if y is. The places at
    which they meet bound what they can still share. ``apart`` is staged.
    """
    part = (1 - similarity) / (1 + similarity)
    sized = apart.join(labels.select(F.col("node").alias("b"), "comp"), "b", "left").withColumn("comp", F.coalesce("comp", "b"))
    sized = sized.withColumn("size", F.size("d").cast("long")).withColumn("near", F.col("size") <= part * (F.col("n") + F.col("p")) + 1e-9)
    sized = sized.withColumn("first", F.col("size") - F.ceil((F.col("size") + part * (F.col("p") - F.col("n"))) / 2 - 1e-9) + 1)
    rows = stage(sized.select("a", "b", "comp", "n", "size", "near", "first", F.explode("d").alias("x")), "differing")
    df = rows.groupBy("a", "x").agg(F.count(F.lit(1)).alias("df"))
    rare = rows.join(df, ["a", "x"]).withColumn("rank", F.row_number().over(Window.partitionBy("a", "b").orderBy("df", "x")))
    rare = rare.where("df > 1").withColumn("leads", F.col("rank") <= F.col("first")).where("leads or not near").drop("df", "first")
    rare = stage(rare, "rare")
    other = rare.where("leads").select("a", "x", *[F.col(c).alias(f"o_{c}") for c in ("b", "comp", "n", "size", "near", "rank")])
    share = F.least(F.col("size") - F.col("rank"), F.col("o_size") - F.col("o_rank")) + 1
    needed = (F.col("size") + F.col("o_size") - part * (F.col("n") + F.col("o_n"))) / 2
    met = F.expr("comp != o_comp and (o_near or (leads and b < o_b))") & (share >= needed - 1e-9)
    found = stage(rare.where("not near").join(other, ["a", "x"]).where(met).select(F.col("b").alias("a"), F.col("o_b").alias("b")).distinct(), "met")
    discard(rows, rare)
    return found


def shareable(texts: DataFrame) -> DataFrame:
    """node, n and s: the size of each text's bag, and of its part that some other of these texts has too.

    Two bags share at most the lesser s, which rules out most pairs of copies with edits of their own.
    """

    def make() -> Callable:
        table = worker_cache("words", Words)

        def run(batch: list[str]) -> list[pa.Array]:
            bags = [bag(t, table) for t in batch]
            return [pa.array([b[0].view(np.int64) for b in bags], pa.list_(pa.int64())), pa.array([b[1].astype(np.int32) for b in bags], pa.list_(pa.int32()))]

        return run

    bags = add_columns(texts, make, "h array<bigint>, c array<int>", keep=["node"])
    sizes = bags.select("node", F.explode(F.arrays_zip("h", "c")).alias("x")).select("node", F.col("x.h").alias("h"), F.col("x.c").alias("c"))
    alone = sizes.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.first("node").alias("node"), F.first("c").alias("c")).where("df = 1")
    whole = sizes.groupBy("node").agg(F.sum("c").alias("n"))
    own = alone.groupBy("node").agg(F.sum("c").alias("u"))
    return whole.join(own, "node", "left").select("node", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("s"))


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the least node it is joined to, for every node of an edge.

    Labels spread along edges and jump to their label's label; each round is written out, so the
    lineage stays short and a lost executor costs a round at most.
    """
    both = stage(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), "edges")
    labels = staged = stage(both.groupBy(F.col("x").alias("node")).agg(F.least(F.first("x"), F.min("y")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "comp"), "y").groupBy("x").agg(F.min("comp").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("x")).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = stage(spread.join(jump, "comp").select("node", "old", F.least("comp", "further").alias("comp")), "labels")
        done = new.where("old != comp").isEmpty()
        discard(staged)
        staged, labels = new, new.select("node", "comp")
        if done:
            discard(both)
            return labels


def merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The labels after some more edges, which are taken between the components there are."""
    if labels is None:
        return components(edges)
    ends = edges
    for side in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}")), side, "left").withColumn(side, F.coalesce(f"c{side}", side)).drop(f"c{side}")
    new = components(ends.where("a != b").select("a", "b").distinct())
    up = labels.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return stage(up.unionByName(new.join(labels.select("node"), "node", "left_anti").select("node", "comp")), "labels")


def _mixed(members: DataFrame) -> DataFrame:
    """The members of buckets that have several components."""
    mixed = members.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("band")
    return members.join(mixed, "band")


def near_components(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every document, and (node, comp) of the nodes with near copies."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("node", F.xxhash64("text"))
    nodes = stage(banded(docs, bands, rows).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "bands")
    spread = nodes.select("node", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # most bands are shared by no two nodes, and of the others there are too many to broadcast
    members = stage(spread.join(shared.hint("merge"), "band"), "members")
    linked = members.groupBy("node").agg(F.sum("n").alias("links"))
    members = stage(members.drop("n").join(linked, "node"), "linked")

    # one document a node, and the texts of those that may have a near copy
    chosen = stage(nodes.select("node", "doc_id").join(linked.select("node"), "node", "left_semi"), "chosen")
    picked = source.alias("s").join(small_side(chosen).alias("c"), (F.col("s.node") == F.col("c.node")) & F.col("s.doc_id").eqNullSafe(F.col("c.doc_id")), "left_semi")
    texts = stage(picked.dropDuplicates(["node"]).select("node", "text"), "texts")

    labels, tried, pivots = None, None, None
    for turn in range(STARS + 1):
        if labels is None:
            now = members.withColumn("comp", F.col("node"))
        else:
            now = stage(_mixed(members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))), "open")
            if now.isEmpty():
                break
        if turn < STARS:
            # the most linked member; later, the most linked outside its component
            best = now.groupBy("band").agg(F.max(F.struct("links", "node", "comp")).alias("p"))
            if turn:
                best = now.join(best, "band").where("comp != p.comp").groupBy("band").agg(F.max(F.struct("links", "node", "comp")).alias("p"))
            else:
                pivots = best = stage(best, "pivots")
            pairs = now.join(best, "band").where("comp != p.comp").select(F.col("p.node").alias("a"), F.col("node").alias("b"))
        else:
            # texts whose bag is mostly their own can be like no other
            here = stage(now.select("node").distinct(), "open-nodes")
            sizes = stage(shareable(texts.join(small_side(here), "node", "left_semi")), "sizes")
            fit = stage(_mixed(now.join(sizes.where(F.col("s") >= similarity * F.col("n") - 1e-9).select("node"), "node")), "fit")
            # every open member was verified against its bucket's first pivot, so pairs with that are done
            from_pivot = stage(fit.join(pivots.select("band", F.col("p.node").alias("a")), "band").select("a", F.col("node").alias("b")).where("a != b").distinct(), "from-pivot")
            apart = stage(differences(from_pivot, texts), "apart")
            pairs = open_pairs(apart, labels, similarity)
            discard(here, sizes, fit, from_pivot, apart)
        pairs = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).dropDuplicates(["lo", "hi"]).drop("lo", "hi")
        if tried is not None:
            done = tried.select("a", "b").union(tried.select("b", "a"))
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        found = stage(verified(stage(pairs, "pairs"), texts), "verified")
        tried = found if tried is None else tried.unionByName(found)
        labels = merged(labels, found.where(F.col("similarity") >= similarity).select("a", "b"))
        if turn:
            discard(now)
    discard(members, chosen, texts, pivots)
    return source.select("doc_id", "node"), labels


def _named(docs: DataFrame) -> DataFrame:
    """comp, node, doc_id and copies of the distinct (text, id) rows, with the class's least id and text, and its rows and entries.

    Only classes of several entries are joined; they are broadcast if they are few, and else Spark
    splits what is large.
    """
    nodes, labels = near_components(docs)
    rows = nodes.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    rows = stage(rows.join(small_side(labels), "node", "left").withColumn("comp", F.coalesce("comp", "node")), "rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("k")
    classes = stage(rows.groupBy("comp").agg(best, F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("entries")).where("entries > 1"), "classes")
    joined = rows.join(small_side(classes), "comp", "left")
    alone = F.col("entries").isNull()
    return joined.select(
        "comp", "node", "doc_id", "copies",
        F.when(alone, F.col("doc_id")).otherwise(F.col("k.doc_id")).alias("class_id"),
        F.coalesce("class_size", "copies").alias("class_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("node") == F.col("k.node")))).alias("wins"),
    )


def classes_of(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its near-duplicate class), kept (one row of a class) and class_size.

    Rows equal in text and id are counted before they meet, and made again from their count.
    """
    runs = _named(docs).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))))
    rows = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("copies")) - 1)))
    return rows.select("doc_id", "class_id", (F.col("wins") & (F.col("copy") == 0)).alias("kept"), "class_size")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the least id, with its columns as they were.

    The others' (node, id) pairs are taken out; only rows repeated in both are reduced by themselves.
    """
    mark, key, own, own_key = "__tidelog_node", "__tidelog_id", "__tidelog_own", "__tidelog_own_id"
    judged = _named(docs).select(F.col("node").alias(mark), F.col("doc_id").alias(key), "wins", "copies")
    losers = stage(judged.where("not wins").select(mark, key), "losers")
    repeated = stage(judged.where("wins and copies > 1").select(mark, key), "repeated")
    rows = docs.withColumn(own, F.xxhash64(text_of(docs))).withColumn(own_key, F.col("doc_id").cast("long"))
    same = (F.col(own) == F.col(mark)) & F.col(own_key).eqNullSafe(F.col(key))
    kept = rows.join(small_side(losers), same, "left_anti")
    if not repeated.isEmpty():
        twice = small_side(repeated)
        kept = kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates([own, own_key]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
