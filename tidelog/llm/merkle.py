"""Document fingerprints: a Merkle tree over blocks, paragraphs and sections, in DataFrame functions only.

A paragraph is a line; its leaves are blocks that end at a full stop or after 160 characters.
A paragraph's node hashes its blocks, a section's node the paragraphs up to one whose hash
starts with 0-3 (so an inserted paragraph shifts no later boundary), the root the sections.
Blocks, paragraphs and newlines give the text back in full, so roots are equal for equal texts
only. The fingerprint is ``root/sections/paragraphs/blocks``; ``likeness`` compares two of
them by their leaves and ``locate`` names the first branch in which they differ.

Edge cases: null text counts as empty and has a fingerprint; texts without newline or full stop
have blocks of 160 characters; equal ``doc_id`` rows are ordered by text; null ids come first;
after the last document comes the first (a single one is its own neighbour).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, text_of

BLOCK = r"[^.]{1,160}+[.]?|[.]"
#: Documents aimed at in a bucket of neighbours, and ranges the ids are cut into first (a square).
BUCKET_ROWS = 256
COARSE = 32


def _nodes(text: Column) -> Column:
    """For each paragraph its hash and its blocks' short hashes."""

    def paragraph(p: Column) -> Column:
        blocks = F.transform(F.regexp_extract_all(p, F.lit(BLOCK), F.lit(0)), lambda b: F.sha2(b, 256))
        return F.struct(F.sha2(F.concat(F.lit("p"), F.concat_ws("", blocks)), 256).alias("hash"), F.array_join(F.transform(blocks, lambda h: F.substring(h, 1, 8)), ",").alias("blocks"))

    return F.transform(F.split(text, "\n", -1), paragraph)


def fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` as ``name``."""
    nodes = df.withColumn("_nodes", _nodes(F.col(text)))
    ends = F.transform(F.col("_nodes.hash"), lambda h: F.concat(h, F.when(F.substring(h, 1, 1).isin("0", "1", "2", "3"), "\n").otherwise("")))
    sections = nodes.withColumn("_sections", F.transform(F.split(F.array_join(ends, ""), "\n", -1), lambda s: F.sha2(F.concat(F.lit("s"), s), 256)))
    short = lambda hashes, n: F.array_join(F.transform(hashes, lambda h: F.substring(h, 1, n)), ",")
    return sections.withColumn(
        name,
        F.concat_ws("/", F.sha2(F.concat(F.lit("r"), F.concat_ws("", "_sections")), 256), short(F.col("_sections"), 16), short(F.col("_nodes.hash"), 12), F.concat_ws(",", "_nodes.blocks")),
    ).drop("_nodes", "_sections")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the Dice share of the leaves that both fingerprints have."""
    leaves = lambda x: F.array_distinct(F.filter(F.split(F.split_part(x, F.lit("/"), F.lit(4)), ","), lambda h: h != ""))
    both = F.transform(F.array(F.struct(leaves(a).alias("x"), leaves(b).alias("y"))), lambda p: 2.0 * F.size(F.array_intersect(p["x"], p["y"])) / F.greatest(F.size(p["x"]) + F.size(p["y"]), F.lit(1)))[0]
    return F.when(F.split_part(a, F.lit("/"), F.lit(1)) == F.split_part(b, F.lit("/"), F.lit(1)), F.lit(1.0)).otherwise(both)


def locate(a: Column, b: Column, level: int) -> Column:
    """Index of the first section (level 2) or paragraph (level 3) that differs; null if none does."""
    x, y = (F.split(F.split_part(c, F.lit("/"), F.lit(level)), ",") for c in (a, b))
    pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
    at = F.array_position(F.transform(pairs, lambda p: ~F.coalesce(p["x"] == p["y"], F.lit(False))), F.lit(True))
    return F.when(at > 0, (at - 1).cast("int"))


def _bounds(docs: DataFrame, id_col: str) -> tuple[list[int], list[int]]:
    """Up to 1024 quantiles of the ids, and for each range the width of its buckets.

    1024 numbers whatever the input; they choose which task sees a row, not what comes out.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("x"))
    n = COARSE * COARSE
    row = ids.agg(F.percentile_approx("x", [i / n for i in range(n)], 10 * n).alias("q")).first()
    bounds = sorted(set(row["q"] or []))
    if not bounds:
        return [], []
    sized = {r["g"]: r for r in ids.where("x is not null").groupBy(_range_of(F.col("x"), bounds).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("top")).collect()}
    # the lowest quantile is approximate: ids below it are in range 0 too and get negative buckets
    return bounds, [max(1, (sized[g]["top"] - bounds[g - 1 if g else 0] + 1) * BUCKET_ROWS // sized[g]["n"]) if g in sized else 1 for g in range(len(bounds) + 1)]


def _literal(values: list[int]) -> Column:
    return F.lit([int(v) for v in values]).cast("array<bigint>")


def _range_of(x: Column, bounds: list[int]) -> Column:
    """How many bounds are at most x, found in two steps of about 32 comparisons."""
    coarse = bounds[::COARSE]
    c = F.size(F.filter(_literal(coarse), lambda b: b <= x))
    return F.when(c > 0, F.transform(F.array(c), lambda k: (k - 1) * COARSE + F.size(F.filter(F.slice(_literal(bounds), (k - 1) * COARSE + 1, F.lit(COARSE)), lambda b: b <= x)))[0]).otherwise(0)


def _bucketed(df: DataFrame, id_col: str, bounds: list[int], widths: list[int]) -> DataFrame:
    if not bounds:
        return df.withColumn("_range", F.lit(0)).withColumn("_bucket", F.lit(-1).cast("long"))
    x = F.col(id_col).cast("long")
    ranged = df.withColumn("_range", F.when(x.isNull(), -1).otherwise(_range_of(x, bounds)))
    low = F.element_at(_literal([bounds[0], *bounds]), F.col("_range") + 1)
    bucket = F.floor((x - low) / F.element_at(_literal(widths), F.col("_range") + 1))
    return ranged.withColumn("_bucket", F.when(F.col("_range") < 0, F.lit(-1)).otherwise(bucket).cast("long"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with their own and the next document's text and fingerprint, by ascending id.

    The ids are cut into buckets of about 256 neighbours, from quantiles and then even steps. One
    shuffle brings each bucket together and a window looks one row ahead; the last row of a bucket
    takes the first of the next bucket, which a join on the few first rows supplies.
    """
    bounds, widths = _bounds(docs, id_col)
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(docs, text).alias("text"))
    rows = _bucketed(base, "doc_id", bounds, widths)
    order = Window.partitionBy("_range", "_bucket").orderBy("doc_id", "text")
    looked = rows.withColumn("next_text", F.lead("text").over(order))
    looked = fingerprint(looked, "text", "fingerprint").withColumn("next_fingerprint", F.lead("fingerprint").over(order)).withColumn("_last", F.col("next_text").isNull())

    # the first id of each bucket, seen from the bucket before it: by bucket within a range, then range by range
    ids = _bucketed(docs.select(F.col(id_col).alias("doc_id")), "doc_id", bounds, widths)
    firsts = ids.groupBy("_range", "_bucket").agg(F.min("doc_id").alias("first_id"))
    along = Window.partitionBy("_range").orderBy("_bucket")
    chained = firsts.withColumn("_next", F.lead(F.struct("first_id", "_bucket")).over(along))
    ends = firsts.groupBy("_range").agg(F.min_by(F.struct("first_id", "_bucket"), "_bucket").alias("head"), F.max("_bucket").alias("tail"))  # a row a range, 1026 at most
    round_trip = Window.partitionBy(F.lit(0)).orderBy("_range")
    hops = ends.select(F.col("_range").alias("_r"), F.col("tail").alias("_b"), F.coalesce(F.lead(F.struct("_range", "head")).over(round_trip), F.first(F.struct("_range", "head")).over(round_trip)).alias("hop"))
    inner = chained.where("_next is not null").select(F.col("_range").alias("_r"), F.col("_bucket").alias("_b"), F.col("_range").alias("_tr"), F.col("_next._bucket").alias("_tb"), F.col("_next.first_id").alias("first_id"))
    targets = inner.unionByName(hops.select("_r", "_b", F.col("hop._range").alias("_tr"), F.col("hop.head._bucket").alias("_tb"), F.col("hop.head.first_id").alias("first_id")))
    targets = stage(targets, "firsts")  # a row for some 256 documents; its size, known then, decides how it is joined
    heads = base.alias("d").join(targets.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.first_id"))).groupBy("_r", "_b").agg(F.min("text").alias("_head"))
    heads = fingerprint(heads, "_head", "_head_fp").select(F.col("_r").alias("_range"), F.col("_b").alias("_bucket"), F.lit(True).alias("_last"), "_head", "_head_fp")
    joined = looked.join(heads, ["_range", "_bucket", "_last"], "left")
    return joined.select("doc_id", "text", "fingerprint", F.coalesce("next_text", "_head").alias("next_text"), F.coalesce("next_fingerprint", "_head_fp").alias("next_fingerprint"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """The contract's rows: each document's fingerprint beside its edited text's and its neighbour's."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = rows.withColumn("_edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("_half")).cast("int")), F.substring("next_text", F.lit(1), F.col("_half"))))
    edited = edited.withColumn("edited_sha256", F.sha2("_edited", 256)).drop("text", "next_text", "_half")
    out = fingerprint(edited, "_edited", "edited_fingerprint").drop("_edited")
    a, b, c = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"), locate(a, b, 2).alias("edit_section"), locate(a, b, 3).alias("edit_paragraph"))
