"""Line dedup (operator 7): a log-template tree, in DataFrame functions only.

A line goes down a tree of fixed depth: first by its number of tokens, then by
its leading tokens, a token with a digit being a variable field. In a leaf,
lines share a template

* if they differ in fields alone,
* if they differ in one more place, or
* if they agree wherever a token recurs at its place in ``min_texts`` texts,

as long as enough of their tokens are constant. Every template is counted over
all lines of its leaf; one that occurs in ``min_texts`` different texts is
boilerplate. So is a long line that two texts hold word for word, whatever its
tokens. The text with the smallest document id keeps its lines, all others lose
them.

Texts are told apart by hash and counted once, however many copies they have:
what is counted, joined and decided is one row for a text's lines of one
template. Rows of documents meet the decisions in the last join alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridlake.llm.common import keyed, stored, text_key

SPACE = r"[\x20\x09-\x0D]+"
#: White space that lines between two single blanks may hold; the line break can't occur.
ODD_SPACE = ("  ", "\t", "\x0b", "\x0c", "\r")
WITH_DIGIT = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
FIELD = "<*>"


@dataclass(frozen=True)
class TemplateParams:
    #: Different texts that make a template, or a token at its place, recurrent.
    min_texts: int = 5
    #: Shorter lines are never templates.
    min_tokens: int = 4
    #: Leading tokens that the tree branches on.
    leading: int = 3
    #: Share of a template's tokens that must be constant.
    constant: float = 0.6
    #: Lines of so many tokens are boilerplate from ``long_texts`` texts on that hold them word for word.
    long_tokens: int = 16
    long_texts: int = 2


def _tokens(words: str) -> Column:
    """Number of tokens, single blanks between them."""
    return F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "))) + 1


def template_lines(rows: DataFrame, params: TemplateParams) -> DataFrame:
    """``doc_id, key, line, leaf, template, verbatim, masked`` of every line of ``min_tokens`` tokens or more;
    ``masked`` holds the tokens between single blanks, ``verbatim`` is null for lines that aren't long."""
    lines = rows.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    content = F.col("content")
    odd = reduce(Column.__or__, [F.contains(content, F.lit(c)) for c in ODD_SPACE], content.startswith(" ") | content.endswith(" "))
    words = F.when(odd, F.trim(F.regexp_replace(content, SPACE, " "))).otherwise(content)
    lines = lines.withColumn("words", words).withColumn("n", _tokens("words")).where(F.col("n") >= params.min_tokens)
    masked = F.when(F.col("words").rlike("[0-9]"), F.regexp_replace("words", WITH_DIGIT, FIELD)).otherwise(F.col("words"))
    return lines.withColumn("masked", masked).select(
        "doc_id", "key", "line", F.xxhash64("n", F.substring_index("masked", " ", params.leading)).alias("leaf"),
        F.xxhash64("masked").alias("template"),
        F.when(F.col("n") >= params.long_tokens, F.xxhash64(F.lit("words"), "words")).alias("verbatim"), "masked")


def recurring(uses: DataFrame, by: str, texts: int) -> DataFrame:
    """``by, keeper`` of what ``texts`` different texts hold, of ``uses(by, key, first)``."""
    each = uses.groupBy(by, "key").agg(F.min("first").alias("first"))
    return each.groupBy(by).agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("keeper")).where(
        F.col("texts") >= texts).select(by, "keeper")


def general_templates(rows: DataFrame, counted: DataFrame, uses: DataFrame, params: TemplateParams) -> DataFrame:
    """``template, keeper`` of the templates that recur together with others of their leaf.

    Tokens are compared by the hash of place and token. What one template
    brings to ``min_texts`` texts needs no more counting, and what cannot reach
    them none either; texts are told apart only among templates that fewer
    texts hold, which have few uses each.
    """
    enough = params.min_texts
    wide = counted.groupBy("leaf").agg(F.sum("texts").alias("n"), F.count(F.lit(1)).alias("templates")).where(
        (F.col("n") >= enough) & (F.col("templates") > 1)).select("leaf")
    open_ = stored(counted.join(wide, "leaf", "left_semi"), "open-templates")
    shown = template_lines(rows, params).select("template", "masked").join(open_.select("template"), "template", "left_semi")
    shown = shown.groupBy("template").agg(F.first("masked").alias("masked")).join(open_, "template")
    shown = shown.withColumn("tokens", F.split("masked", " ")).select(
        "leaf", "template", "texts", "keeper", F.size("tokens").alias("n"),
        F.size(F.filter("tokens", lambda t: t != FIELD)).alias("constant"),
        F.transform("tokens", lambda t, i: F.struct(F.xxhash64(i, t).alias("code"), (t != FIELD).alias("fixed"))).alias("tokens"))
    shown = stored(shown, "open-lines")
    few = stored(uses.join(open_.where(F.col("texts") < enough).select("template"), "template", "left_semi").select(
        "template", "key"), "open-uses")

    def in_texts(members: DataFrame, by: str) -> DataFrame:
        """``by, least`` of the groups of ``members(by, template, texts, keeper)`` that ``min_texts`` texts hold."""
        sums = members.groupBy(by).agg(F.sum("texts").alias("t"), F.max("texts").alias("most"), F.min("keeper").alias("least"))
        sums = sums.where(F.col("t") >= enough)
        rare = members.select(by, "template").join(sums.where(F.col("most") < enough).select(by), by, "left_semi")
        rare = rare.join(few, "template").select(by, "key").distinct().groupBy(by).agg(F.count(F.lit(1)).alias("k"))
        return sums.join(rare, by, "left").where((F.col("most") >= enough) | (F.col("k") >= enough)).select(by, "least")

    def spread(members: DataFrame, by: str) -> DataFrame:
        """``template, keeper`` of the members of recurring groups."""
        return members.select(by, "template").join(in_texts(members, by), by).select("template", F.col("least").alias("keeper"))

    # all tokens but one: a combination of hashes that takes one of them back
    whole = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(t["code"]))
    rests = F.transform("tokens", lambda t, i: F.when(
        F.col("constant") - t["fixed"].cast("int") >= params.constant * F.col("n"),
        F.xxhash64(F.col("leaf"), i, F.col("whole").bitwiseXOR(t["code"]))))
    others = shown.withColumn("whole", whole).select("template", "texts", "keeper", F.explode(rests).alias("rest")).where(
        "rest IS NOT NULL")
    one_place = spread(others, "rest")

    spots = shown.select("leaf", "template", "texts", "keeper", F.explode("tokens").alias("t")).where("t.fixed")
    spots = spots.select("template", "texts", "keeper", "t.code", F.xxhash64("leaf", "t.code").alias("spot"))
    seen = spots.select("template", "code", "spot").join(in_texts(spots, "spot").select("spot"), "spot", "left_semi")
    shapes = seen.groupBy("template").agg(F.count(F.lit(1)).alias("fixed"), F.bit_xor("code").alias("shape"))
    shapes = shapes.join(shown.select("leaf", "template", "texts", "keeper", "n"), "template").where(
        F.col("fixed") >= params.constant * F.col("n"))
    shapes = shapes.select("template", "texts", "keeper", F.xxhash64("leaf", "fixed", "shape").alias("shape"))
    return one_place.unionByName(spread(shapes, "shape"))


def dropped_lines(rows: DataFrame, params: TemplateParams) -> DataFrame:
    """``key, dropped`` of ``rows(doc_id, key, text)``: numbers of the lines that a text loses, where it loses any."""
    lines = template_lines(rows, params)
    constant = F.size(F.filter(F.split("masked", " "), lambda t: t != FIELD)) >= params.constant * _tokens("masked")
    steady = ~F.contains("masked", F.lit(FIELD)) | constant
    uses = stored(lines.withColumn("steady", steady).groupBy("leaf", "template", "steady", "verbatim", "key", "line").agg(
        F.min("doc_id").alias("first")), "template-uses")
    each = uses.where("steady").groupBy("leaf", "template", "key").agg(F.min("first").alias("first"))
    counted = stored(each.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("keeper")),
                     "template-counts")
    found = counted.where(F.col("texts") >= params.min_texts).select("template", "keeper")
    found = found.unionByName(general_templates(rows, counted, uses.select("template", "key").distinct(), params))
    found = stored(found.groupBy("template").agg(F.min("keeper").alias("keeper")), "boilerplate")
    long = stored(recurring(uses.where("verbatim IS NOT NULL").select("verbatim", "key", "first"), "verbatim",
                            params.long_texts), "long-lines")
    lost = [uses.join(table, by).where(~F.col("first").eqNullSafe(F.col("keeper"))).select("key", "line")
            for table, by in ((found, "template"), (long, "verbatim"))]
    return lost[0].unionByName(lost[1]).groupBy("key").agg(F.collect_set("line").alias("dropped"))


def drop_boilerplate(docs: DataFrame, params: TemplateParams = TemplateParams(), id_col: str = "doc_id",
                     text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs``, all columns, without the boilerplate lines; in ``count_col``, if named, how many went.

    Texts are counted, not rows: exact copies count once, and all copies of the
    keeping text keep. A null text stays null, an empty one empty. A template
    that only texts without an id have is kept by all of them. Very long texts
    are read line by line; taking lines away is linear in their number.
    """
    lost = stored(dropped_lines(keyed(docs, id_col, text_col).withColumn("key", text_key()), params), "dropped-lines")
    # texts travel as their lines, which are then looked up by number
    row = [(F.split(text_col, "\n") if c == text_col else F.col(c)).alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*row).alias("row"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    # never broadcast: what texts lose grows with them, and the plan should be one at every size
    lost = lost.select(F.col("key").alias("lost_key"), "dropped").hint("merge")
    joined = rows.join(lost, F.col("key") == F.col("lost_key"), "left")
    lines = F.col("row")[text_col]
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "dropped")
    kept = F.when(F.col("dropped").isNull(), lines).otherwise(F.transform(left, lambda i: F.get(lines, i)))
    columns = [(F.array_join(kept, "\n") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns]
    count = F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    return joined.select(*columns, *([count.alias(count_col)] if count_col else []))
