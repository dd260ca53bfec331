"""Document fingerprints: every shingle hash below a fixed fraction of the hash range (native columns only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import base

# Words of a shingle; a sketch keeps the 2**-LEVEL part of the hash range, that of a text of up to SHORT shingles keeps all of it (level 0).
WORDS = 3
LEVEL = 3
SHORT = 64


def _below(hashes: Column, level: Column) -> Column:
    """Hashes in the lowest 2**-level part of the range."""
    bound = F.lit(-(1 << 63)) + F.call_function("shiftright", F.lit(1 << 62).cast("long"), level - 2)  # of levels 2 and up
    bound = F.when(level == 1, F.lit(0).cast("long")).otherwise(bound)

    def keep(b: Column) -> Column:
        return F.filter(hashes, lambda h: h < b)

    return F.when(level == 0, hashes).otherwise(F.get(F.transform(F.array(bound), keep), F.lit(0)))


def sketch(text: Column, words: int = WORDS, level: int = LEVEL, short: int = SHORT) -> Column:
    """struct(level, hashes): the sorted distinct hashes of the text's word shingles in the lowest 2**-level part of the range; all of them
    (level 0) for a text of up to `short` shingles. Fewer words than a shingle: all of them as one; no words (null or empty text): no hashes.

    Nothing else is kept, so at a common level the union of sketches is the sketch of the union (merged).
    """
    w = F.array_remove(F.split(F.coalesce(text, F.lit("")), base.BLANKS), "")

    def hashes(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ws) - words)
        full = F.transform(starts, lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(words)]))
        return F.when(F.size(ws) >= words, full).when(F.size(ws) > 0, F.array(F.xxhash64(F.concat_ws(" ", ws)))).otherwise(
            F.array().cast("array<bigint>"))

    def keep(hs: Column) -> Column:
        at = F.when(F.size(hs) > short, level).otherwise(0)
        return F.struct(at.alias("level"), F.array_sort(F.array_distinct(_below(hs, at))).alias("hashes"))

    # One-element transforms bind a value once, where a repeated expression would be worked out again.
    return F.get(F.transform(F.transform(F.array(w), hashes), keep), F.lit(0))


def as_text(s: Column) -> Column:
    """The level, then hexadecimal hashes, joined by dots; equal sketches give equal texts."""
    return F.concat_ws(".", s["level"].cast("string"), F.array_join(F.transform(s["hashes"], F.hex), "."))


def _common(a: Column, b: Column) -> tuple[Column, Column]:
    """The hashes of two sketches at the higher of their levels."""
    level = F.greatest(a["level"], b["level"])
    return tuple(F.when(s["level"] == level, s["hashes"]).otherwise(_below(s["hashes"], level)) for s in (a, b))


def merged(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together, at the higher of the levels."""
    x, y = _common(a, b)
    return F.struct(F.greatest(a["level"], b["level"]).alias("level"), F.array_sort(F.array_union(x, y)).alias("hashes"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the shingle sets, exact between texts of level 0. Two sketches blank at their common level are alike if
    they are equal, else not."""
    x, y = _common(a, b)
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    return F.when(union == 0, (a == b).cast("double")).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has: exact if both are level 0. Null where a has no hash at the common level to judge by; a
    text without words is contained in any."""
    x, y = _common(a, b)
    return F.when((a["level"] == 0) & (F.size(a["hashes"]) == 0), 1.0).when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x))


def _at_or_above(key: Column, cuts: list, width: int = 64) -> Column:
    """How many of the ascending cuts are at or above the key: first by blocks of cuts, then within the key's block."""
    if not cuts:
        return F.lit(0)
    blocks = [cuts[i:i + width] for i in range(0, len(cuts), width)]
    below = lambda values: F.size(F.filter(values, lambda c: c < key))
    block = below(F.array(*[F.lit(b[-1]) for b in blocks]))
    inner = F.coalesce(F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), block), F.array().cast("array<bigint>"))
    return F.greatest(F.lit(0), F.lit(len(cuts)) - block * width - below(inner))


def with_next(docs: DataFrame, key: str, cols: list[str], slices: int) -> DataFrame:
    """Adds struct `next`: the columns of the row after each in descending key order; after the last comes the first.

    The order is cut at quantiles of the key into slices. A window works in each, to which the first row of the following
    slice is added. Ties go by the columns; null keys come last; a lone row is its own next.
    """
    cuts: list = []
    if slices > 1:
        shares = ", ".join(str(i / slices) for i in range(1, slices))
        cuts = sorted(set(docs.agg(F.expr(f"percentile_approx({key}, array({shares}), 10000)").alias("q")).first()["q"] or []))
    above = _at_or_above(F.col(key), cuts)  # 0 is the highest slice, null keys have the last
    sliced = docs.withColumn("_slice", F.when(F.col(key).isNull(), len(cuts) + 1).otherwise(above))
    order = [F.col(key).desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in cols]]
    tops = sliced.groupBy("_slice").agg(F.max(key).alias("_top"))
    before = F.coalesce(F.lag("_slice").over(Window.orderBy("_slice")), F.max("_slice").over(Window.orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)))
    tops = F.broadcast(tops.withColumn("_before", before))  # one row per slice
    heads = sliced.alias("d").join(tops.alias("t"), (F.col("d._slice") == F.col("t._slice")) & F.col(f"d.{key}").eqNullSafe(F.col("t._top")))
    heads = heads.select("d.*", "_before").withColumn("_n", F.row_number().over(Window.partitionBy("_slice").orderBy(*order))).where("_n = 1")
    heads = heads.withColumn("_slice", F.col("_before")).select(*sliced.columns, F.lit(1).alias("_guest"))
    w = Window.partitionBy("_slice").orderBy(F.col("_guest"), *order)
    both = sliced.withColumn("_guest", F.lit(0)).unionByName(heads)
    return both.withColumn("next", F.lead(F.struct(*cols)).over(w)).where("_guest = 0").drop("_guest", "_slice")


def fingerprint_edits(docs: DataFrame, words: int = WORDS, level: int = LEVEL, slice_rows: int = 4000, most_slices: int = 4096) -> DataFrame:
    """Each document's sketch, that of its edited text, and their likenesses.

    The edited text has its last third (floor of n_chars / 3) replaced by as many first characters of the next document in
    descending doc_id, or all it has. The order is cut into slices of about slice_rows documents, most_slices at the most. Null texts are empty; ties of doc_id go by text; null ids come last; an empty
    table gives no rows; a lone document is its own next; other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("hashes", sketch(F.col("text"), words, level))
    slices = max(1, min(most_slices, -(-own.count() // slice_rows)))
    placed = with_next(own, "doc_id", ["text", "hashes"], slices)
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("next.text"), F.lit(1), third))
    out = placed.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited)
    out = out.withColumn("edited_hashes", sketch(F.col("edited"), words, level))
    return out.select("doc_id", "n_chars", "edited", "hashes", "edited_hashes", F.col("next.hashes").alias("next_hashes"))
