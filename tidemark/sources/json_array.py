"""One large JSON document with an array of objects, read by as many tasks as its bytes fill.

The file is read as text cut at closing braces, which the text source splits anywhere. Where a piece stands in the
document follows from the pieces before it: whether it begins inside a string (an odd number of quotes so far) and how
deep (brackets outside strings so far). Both are sums, formed for each split of the file first and then run on over the
splits; within a split they run over its pieces. Pieces of one element are then put together by its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources import materialize


def _outside(text: Column, inside: Column) -> Column:
    """The text without strings and what escapes in them, given whether it begins inside a string."""
    plain = F.regexp_replace(text, r'\\.', "")
    # a quote in front makes a text that begins inside a string one that begins outside
    whole = F.when(inside, F.concat(F.lit('"'), plain)).otherwise(plain)
    return F.regexp_replace(whole, r'"[^"]*("|$)', "")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _running(facts: DataFrame, value: Column, name: str) -> DataFrame:
    """facts, written, with the sum of value over all pieces of the file before them."""
    rows = materialize(facts.withColumn("_v", value), "pieces")
    split = rows.groupBy("file", "split").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    split = split.select("file", "split", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("file", "split").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(split, ["file", "split"]).withColumn(name, F.col("_base") + F.coalesce(F.sum("_v").over(own), F.lit(0))).drop("_v", "_base")


def _joined(rows: DataFrame, by: list[str]) -> DataFrame:
    """The texts of a group in their order, as json."""
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "nth", "t"))), lambda x: x["t"]), "").alias("json"))


def elements(spark: SparkSession, path: str, name: str = "observations") -> tuple[DataFrame, DataFrame]:
    """(elements, headers) of JSON files: file, element (its number) and json of each object in the array `name` of the top level, and file and json of each document with an empty array in its place.

    A document that is itself an array of objects has no header. The array's elements are objects; the array is the only
    part of a document that may be large. Empty arrays, and documents without the array, have no elements.
    """
    c = F.col
    place = ["file", "split", "nth"]
    raw = spark.read.option("lineSep", "}").text(path).select(c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("split"), c("value").alias("text"), F.monotonically_increasing_id().alias("nth"))
    pieces = materialize(raw, "texts")
    # what the sums need of a text, whether it begins outside a string (0) or inside one (1); the texts stay where they are
    level = lambda text, inside: _count(_outside(text, F.lit(inside)), "{[") - _count(_outside(text, F.lit(inside)), "]}")
    key = f'(?s)^(.*?"{name}"\\s*:\\s*\\[)'
    front = F.regexp_extract("text", key, 1)
    past_front, past_bracket = F.substring(c("text"), F.length(front) + 1, F.length("text")), F.regexp_replace("text", r"^\s*\[", "")
    shut = lambda text: F.regexp_like(text, F.lit(r"^\s*\]"))
    last = pieces.groupBy("file").agg(F.max(F.struct("split", "nth")).alias("last"))
    facts = pieces.join(last, "file").select(
        *place, _count(F.regexp_replace("text", r"\\.", ""), '"').alias("own_quotes"), *[level(c("text"), i).alias(f"level{int(i)}") for i in (False, True)], *[F.when(front != "", level(front, i)).alias(f"front{int(i)}") for i in (False, True)],
        F.regexp_like("text", F.lit(r"^\s*\[")).alias("bracket"), shut(c("text")).alias("shut0"), shut(past_bracket).alias("shut1"), shut(past_front).alias("shut2"), (F.struct("split", "nth") < c("last")).alias("cut"),
    )
    facts = _running(facts, c("own_quotes"), "quotes")
    inside, ends_inside = c("quotes") % 2 == 1, (c("quotes") + c("own_quotes")) % 2 == 1
    # the brace at which a piece was cut closes an object, unless it is in a string or the piece ends the file
    facts = facts.select(*place, "bracket", "shut0", "shut1", "shut2", "cut", inside.alias("inside"), (c("cut") & ~ends_inside).alias("closes"), F.when(inside, c("level1")).otherwise(c("level0")).alias("level"), F.when(inside, c("front1")).otherwise(c("front0")).alias("front"))
    facts = _running(facts, c("level") - c("closes").cast("int"), "depth").withColumn("open", c("depth") + c("level"))
    # a brace at the very end of a file isn't told apart from none: it is there if the document is still open
    at_end = ~c("cut") & (c("open") == 1)
    facts = facts.withColumns({"cut": c("cut") | at_end, "closes": c("closes") | at_end}).withColumn("after", c("open") - c("closes").cast("int")).drop("open")
    # where the array begins: with the document, or after its name at the top level
    first = (c("split") == 0) & (c("depth") == 0) & ~c("inside")
    root = F.when(first & c("bracket"), 1).when(c("front").isNotNull() & (c("depth") + c("front") == 2), 2).otherwise(0)
    facts = _running(facts.withColumn("root", root), c("root"), "root_before").withColumn("kind", F.greatest("root", "root_before"))
    # between elements, a bracket closes the array
    tail = (c("kind") > 0) & F.when(c("root") == 1, c("shut1")).when(c("root") == 2, c("shut2")).otherwise(c("shut0") & (c("depth") == c("kind")))
    facts = _running(facts.withColumn("tail", tail), c("tail").cast("int"), "closed")
    held = (c("kind") > 0) & (c("closed") == 0) & ~c("tail")
    facts = facts.withColumn("held", held).withColumn("ends", c("held") & c("closes") & (c("after") == c("kind")))
    facts = _running(facts, c("ends").cast("int"), "element").select(*place, "root", "kind", "held", "ends", "element", F.when(c("cut"), "}").otherwise("").alias("brace"))
    both = pieces.join(facts, place)
    rest = F.concat(F.when(c("root") == 1, past_bracket).when(c("root") == 2, past_front).otherwise(c("text")), "brace")
    rows = _joined(both.where("held").withColumn("t", rest), ["file", "element"]).join(facts.where("ends").select("file", "element"), ["file", "element"]).withColumn("json", F.regexp_replace("json", r"^[\s,]+", ""))
    begins = F.when(c("root") == 2, F.substring(c("text"), F.lit(1), F.length(front))).otherwise("")
    outer = both.where("kind <> 1 and (not held or root = 2)").withColumn("t", F.concat(begins, F.when(c("held"), "").otherwise(rest)))
    return rows, _joined(outer, ["file"])
