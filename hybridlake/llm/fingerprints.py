"""Document fingerprints (operator 9): threshold-scaled sketches, in DataFrame functions only.

A text's sketch keeps every shingle hash below a fixed fraction of the hash
range (its least one if none is). Sketches of parts merge into the sketch of
the whole, and the share of one sketch in another estimates containment also
between texts of very unequal length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hybridlake.llm.common import keyed, text_key

SHINGLE_WORDS = 5
#: One hash in so many is kept.
ONE_IN = 8
SPACE = r"[\x20\x09-\x0D]+"


def bind(value: Column, use) -> Column:
    """``use(value)``, with ``value`` evaluated once however often it is used."""
    return F.transform(F.array(value), use)[0]


def shingles(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """Hashes of a text's word shingles; fewer words make one shingle, none none."""
    words = F.transform(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    many = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(
        *[F.get(h, i + j) for j in range(width)]))
    none = F.array().cast("array<bigint>")
    return bind(words, lambda h: F.when(F.size(h) >= width, many(h)).when(
        F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(none))


def retain(hashes: Column, one_in: int = ONE_IN) -> Column:
    """The hashes below the threshold, or else the least; distinct and sorted."""
    limit = F.lit(-(1 << 63) + (1 << 64) // one_in)
    return bind(hashes, lambda h: bind(F.filter(h, lambda x: x < limit), lambda kept: F.when(
        (F.size(kept) > 0) | (F.size(h) == 0), F.sort_array(F.array_distinct(kept))).otherwise(F.array(F.array_min(h)))))


def sketch(text: Column, width: int = SHINGLE_WORDS, one_in: int = ONE_IN) -> Column:
    return retain(shingles(text, width), one_in)


def merged(a: Column, b: Column, one_in: int = ONE_IN) -> Column:
    """The sketch of two texts' shingles taken together."""
    return retain(F.array_union(a, b), one_in)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all (Jaccard); 1 for two empty sketches."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first's shingles that the second has; 1 if the first is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def written(a: str) -> Column:
    """A sketch as text: its hashes in hexadecimal."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), " ")


def _range(id_: Column, splits: list) -> Column:
    """Number of splits at or below an id, in two steps of about the root of their number."""
    if not splits:
        return F.lit(0)
    step = max(1, math.isqrt(len(splits)))
    groups = [splits[i:i + step] for i in range(0, len(splits), step)]
    at_most = lambda values: F.size(F.filter(values, lambda s: s <= id_))
    heads = F.array(*[F.lit(g[0]) for g in groups])
    tails = F.array(*[F.array(*[F.lit(s) for s in g]) for g in groups])
    coarse = at_most(heads)
    fine = F.when(coarse == 0, 0).otherwise((coarse - 1) * step + at_most(F.get(tails, coarse - 1)))
    return F.coalesce(fine, F.lit(0))


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """``rows(doc_id, text, ...)`` with ``next_<c>`` of the row that follows by ``doc_id``.

    After the last comes the first. Rows are dealt by ranges of the id (as
    many as there are shuffle partitions), each ordered by itself; the first
    row of a range is copied to the end of the one before. Null ids come first;
    rows with one id are ordered by their text's hash.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = rows.select(F.col("doc_id").cast("double").alias("id")).where("id is not null").approxQuantile(
        "id", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    splits = sorted({int(math.ceil(q)) for q in quantiles})
    dealt = rows.withColumns({"_range": _range(F.col("doc_id"), splits), "_key": text_key()})
    firsts = dealt.groupBy("_range").agg(F.min("doc_id").alias("id"), F.count("doc_id").alias("ids"),
                                         F.count(F.lit(1)).alias("n")).orderBy("_range").collect()  # <= parts rows
    if not firsts:
        return rows.withColumns({f"next_{c}": F.col(c) for c in carried})
    heads = [F.struct(F.lit(r["_range"]).alias("_at"), F.lit(firsts[i - 1]["_range"]).alias("_before"),
                      F.lit(r["id"] if r["ids"] == r["n"] else None).cast(rows.schema["doc_id"].dataType).alias("_id"))
             for i, r in enumerate(firsts)]
    heads = spark.range(1).select(F.explode(F.array(*heads)).alias("h")).select("h.*")
    found = dealt.join(F.broadcast(heads), dealt["doc_id"].eqNullSafe(heads["_id"]) & (dealt["_range"] == heads["_at"]))
    one = F.row_number().over(Window.partitionBy("_at").orderBy("_key"))
    found = found.withColumn("_n", one).where("_n = 1").withColumns({"_range": F.col("_before"), "_copy": F.lit(1)})
    both = dealt.withColumn("_copy", F.lit(0)).unionByName(found.drop("_n", "_at", "_before", "_id"))
    order = Window.partitionBy("_range").orderBy("_copy", F.col("doc_id").asc_nulls_first(), "_key")
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where("_copy = 0").drop(
        "_copy", "_range", "_key")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's sketch beside those of its edited text and of the next document's.

    The edited text has its last quarter replaced by the beginning of the next
    document. Returns ``doc_id, n_chars, edited, sketch, edited_sketch,
    near_edited, near_next, in_edited``. A null text is empty: its sketch is
    empty too, and like another empty one. Repeated rows each get their row.
    """
    rows = keyed(docs, id_col, text_col).withColumn("sketch", sketch(F.col("text")))
    rows = with_next(rows, ["text", "sketch"]).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")),
                      F.substring("next_text", F.lit(1), cut))
    rows = rows.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    mine, other = F.col("sketch"), F.col("edited_sketch")
    return rows.select("doc_id", "n_chars", "edited", "sketch", "edited_sketch",
                       likeness(mine, other).alias("near_edited"), likeness(mine, F.col("next_sketch")).alias("near_next"),
                       containment(mine, other).alias("in_edited"))
