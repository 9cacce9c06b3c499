"""Nested payloads: values flattened by path at any depth, and payloads held once under the hash of their content.

Payloads are walked level by level; each level is one pass over the values that are themselves nested, and is written, so
that a deep payload costs as many passes as it has levels and no task holds more than a value. In a store every distinct
part is a node named by the hash of its content, in which nested parts stand as references. Nodes are put together
from the leaves up, each once, however many payloads share it; what is left when no node can be finished has a
reference that leads nowhere, or one that leads back. Both sides of these joins grow with the payloads, so that they are
sorted and merged, and no part of a store is collected by the driver to be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources import materialize

# Keys and tokens that tell of a use of what wasn't known yet.
WARNING_KEYS = ("pit_warning", "pit_unsafe", "future_unsafe", "future_unsafe_warning")
WARNING_TOKENS = ("pit_warning", "pit_unsafe", "future_unsafe")
TEXT_KEYS = ("warnings", "warning", "reason")


def _kind(v: Column) -> Column:
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), "object").when(F.schema_of_variant(v).startswith("ARRAY"), "array").otherwise("value")


def _explode(rows: DataFrame, keep: Sequence[str], value: str = "v") -> DataFrame:
    """One row for each entry of an object or array: keep, pos, key, value."""
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(value).outer())).select(*keep, "pos", "key", "value")


def _label(name: Column) -> Column:
    """What stands before a value: its name as a JSON string and a colon in an object, nothing in an array."""
    text = F.to_json(F.array(name))
    return F.when(name.isNotNull(), F.concat(F.substring(text, F.lit(2), F.length(text) - 2), F.lit(":"))).otherwise("")


def flattened(rows: DataFrame, keys: Sequence[str], payload: str, stop: Column | None = None) -> DataFrame:
    """keys, path, name, kind and value (as JSON text) of everything inside a payload of JSON text, at any depth.

    An entry of an array has the array's name. Text that isn't JSON, and null, has nothing inside. stop is a condition on
    `name` (in small letters, hyphens as underscores) under which a value isn't walked into.
    """
    level = rows.select(*keys, F.lit("$").alias("path"), F.lit("").alias("name"), F.try_parse_json(payload).alias("v")).where(F.col("v").isNotNull() & (_kind(F.col("v")) != "value"))
    found: list[DataFrame] = []
    while True:
        part = _explode(level, [*keys, "path", "name"])
        own = F.coalesce(F.translate(F.lower("key"), "-", "_"), F.col("name"))
        path = F.concat("path", F.coalesce(F.concat(F.lit("."), "key"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))))
        part = part.select(*keys, path.alias("path"), own.alias("name"), _kind(F.col("value")).alias("kind"), F.to_json("value").alias("value"))
        part = materialize(part, "level")
        found.append(part)
        deeper = F.col("kind") != "value"
        if stop is not None:
            deeper = deeper & ~F.coalesce(stop, F.lit(False))
        deep = part.where(deeper)
        if deep.isEmpty():
            return reduce(DataFrame.unionByName, found)
        level = deep.select(*keys, "path", "name", F.parse_json("value").alias("v"))


def _alarm(name: Column) -> Column:
    """Whether a key by itself tells of such a use, if its value isn't empty."""
    return name.isin(*WARNING_KEYS) | (name.contains("pit") & (name.contains("warning") | name.contains("unsafe")))


def pit_warnings(rows: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """keys and warnings, the number of places of a payload that tell of a use of what wasn't known yet; payloads without one are left out.

    Such are a warning key with a value that isn't empty, zero or false; a key that says PIT is safe with the value false;
    and a text that names one under `warnings`, `warning` or `reason`, or in a list there. Nothing is looked for below a
    warning key.
    """
    name = F.col("name")
    all_parts = flattened(rows, keys, payload, _alarm(name))
    empty = F.col("value").isin("null", "false", "0", '""', "[]", "{}") | F.coalesce(F.col("value").try_cast("double") == 0, F.lit(False))
    safe = name.contains("safe") & name.contains("pit") & ~_alarm(name) & (F.col("value") == "false")
    text = F.translate(F.lower(F.col("value")), "- ", "__")
    told = name.isin(*TEXT_KEYS) & F.col("value").startswith('"') & text.rlike("|".join(WARNING_TOKENS))
    hit = F.when(_alarm(name), ~empty & ~F.col("path").endswith("]")).otherwise(safe | told)
    return all_parts.where(hit).groupBy(*keys).agg(F.count("*").alias("warnings"))


# Content-addressed stores


def merged(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the store: neither passes through the driver, however small its files are."""
    return left.join(right.hint("merge"), on, how)


def store(rows: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Payloads of JSON text as roots (key, ref_id), nodes (ref_id, kind) and entries (ref_id, at, name, text, child).

    An entry holds a value's JSON text, or the ref_id of a nested part as child. Objects are in the order of their names,
    whatever order they came in. A payload that isn't JSON, or isn't an object or array, has no ref_id.
    """
    v = F.try_parse_json(payload)
    asked = materialize(rows.select(key, v.alias("v")).select(key, F.when(F.col("v").isNotNull() & (_kind(F.col("v")) != "value"), F.to_json("v")).alias("json")), "payloads")
    level = asked.where("json is not null").select("json").distinct()
    parts: list[DataFrame] = []
    while True:
        # each distinct part of a level once; its full text names it until its content does
        part = _explode(level.select("json", F.parse_json("json").alias("v")), ["json"])
        kind = _kind(F.col("value"))
        part = materialize(part.select(F.sha2("json", 256).alias("whole"), F.coalesce("key", F.format_string("%010d", "pos")).alias("at"), F.col("key").alias("name"), F.to_json("value").alias("text"), (kind != "value").alias("nested")), "parts")
        parts.append(part)
        deep = part.where("nested").select(F.col("text").alias("json")).distinct()
        if deep.isEmpty():
            break
        level = deep
    entries = materialize(reduce(DataFrame.unionByName, parts).dropDuplicates(["whole", "at"]).withColumn("inner", F.when(F.col("nested"), F.sha2("text", 256))), "entries")
    # empty objects and arrays have no entries
    texts = asked.where("json is not null").select("json").unionByName(entries.where("nested").select(F.col("text").alias("json"))).distinct()
    whole = materialize(texts.select(F.sha2("json", 256).alias("whole"), F.when(F.col("json").startswith("{"), "object").otherwise("array").alias("kind")), "wholes")
    piece = F.concat(_label(F.col("name")), F.coalesce(F.concat(F.lit("->"), "child"), "text"))
    named = whole.limit(0).select("whole", "kind", F.lit("").alias("ref_id"))
    while True:
        known = merged(entries, named.select(F.col("whole").alias("inner"), F.col("ref_id").alias("child")), "inner", "left")
        ready = known.groupBy("whole").agg(F.count_if(F.col("nested") & F.col("child").isNull()).alias("open"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("at", piece.alias("p")))), lambda x: x["p"])).alias("content"))
        every = merged(whole, ready, "whole", "left").where("coalesce(open, 0) = 0")
        new = materialize(every.select("whole", "kind", F.sha2(F.concat("kind", F.lit(":"), F.coalesce("content", F.lit(""))), 256).alias("ref_id")), "named")
        before, named = named.count(), new
        if new.count() == before:
            break
    ids = named.select("whole", "ref_id")
    roots = merged(asked.select(key, F.sha2("json", 256).alias("whole")), ids, "whole", "left").select(key, "ref_id")
    out = merged(merged(entries, ids, "whole"), named.select(F.col("whole").alias("inner"), F.col("ref_id").alias("child")), "inner", "left")
    return roots, named.select("ref_id", "kind").distinct(), out.select("ref_id", "at", "name", F.when(~F.col("nested"), F.col("text")).alias("text"), "child").distinct()


def expand(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """ref_id, status, json and height of each node: `ok` with its JSON text, or why it can't be put together.

    `dangling`: it refers to a node that isn't there; `below`: something that it refers to does, at any depth; `loop`: it
    leads back to itself, or to nodes that do. A node's height is the longest way down from it.
    """
    piece = F.concat(_label(F.col("name")), F.coalesce("json", "text"))
    done = nodes.limit(0).select("ref_id", F.lit("").alias("json"), F.lit(0).alias("height"))
    count = 0
    while True:
        e = merged(entries, done.select(F.col("ref_id").alias("child"), "json", "height"), "child", "left")
        body = e.groupBy("ref_id").agg(F.count_if(F.col("child").isNotNull() & F.col("json").isNull()).alias("open"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("at", piece.alias("p")))), lambda x: x["p"])).alias("body"), F.max(F.col("height") + 1).alias("height"))
        text = F.when(F.col("kind") == "object", F.concat(F.lit("{"), F.coalesce("body", F.lit("")), F.lit("}"))).otherwise(F.concat(F.lit("["), F.coalesce("body", F.lit("")), F.lit("]")))
        done = materialize(merged(nodes, body, "ref_id", "left").where("coalesce(open, 0) = 0").select("ref_id", text.alias("json"), F.coalesce("height", F.lit(0)).alias("height")), "expanded")
        if (n := done.count()) == count:
            break
        count = n
    left = merged(nodes, done, "ref_id", "left_anti").select("ref_id")
    edges = materialize(merged(entries.where("child is not null").select("ref_id", "child").distinct(), left, "ref_id", "left_semi"), "edges")
    dangling = materialize(merged(edges, nodes.select(F.col("ref_id").alias("child")), "child", "left_anti").select("ref_id").distinct(), "dangling")
    marked = dangling
    count = marked.count()
    while count:
        marked = materialize(marked.union(merged(edges, marked.select(F.col("ref_id").alias("child")), "child", "left_semi").select("ref_id")).distinct(), "marked")
        if (n := marked.count()) == count:
            break
        count = n
    why = merged(merged(left, dangling.withColumn("d", F.lit(True)), "ref_id", "left"), marked.withColumn("m", F.lit(True)), "ref_id", "left")
    why = why.select("ref_id", F.when(F.col("d"), "dangling").when(F.col("m"), "below").otherwise("loop").alias("status"))
    return done.select("ref_id", F.lit("ok").alias("status"), "json", "height").unionByName(why, allowMissingColumns=True)
