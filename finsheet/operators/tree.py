"""Walking JSON of unknown depth: every value with its path, level by level over variants.

A document's root is its first node; each level adds the children of the objects and arrays found on the one before, for all
documents at once, so there are as many levels as the deepest document has and no row holds a whole walk. A level is one
generator over the rows that are there: nothing is shuffled, and a task walks the documents that it reads. Text that
is no JSON has no node. Fields of an object come in the order of their names, as variants keep them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsheet.operators.forecast import state_blob

_CHILDREN = "array<struct<path:string,parent:string,key:string,depth:int,value:variant>>"


def levels(json: Column) -> Column:
    """How many objects and arrays stand in one another at most in a text of JSON; what strings hold does not count."""
    brackets = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]{}]++", "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        at = s["at"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        return F.struct(at.alias("at"), F.greatest(s["most"], at).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda s: s["most"])


def _children(n: Column) -> Column:
    """The fields of a node's object or the elements of its array as nodes; NULL for other values."""
    node = lambda step, key, value: F.struct(F.concat(n["path"], step).alias("path"), n["path"].alias("parent"), key.alias("key"), (n["depth"] + 1).alias("depth"), value.alias("value"))
    step = lambda k: F.when(k.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), k)).otherwise(F.concat(F.lit('["'), F.replace(k, F.lit('"'), F.lit('\\"')), F.lit('"]')))
    fields = F.transform(F.map_entries(F.try_variant_get(n["value"], "$", "map<string,variant>")), lambda e: node(step(e["key"]), e["key"], e["value"]))
    elements = F.transform(F.try_variant_get(n["value"], "$", "array<variant>"), lambda v, i: node(F.concat(F.lit("["), i.cast("string"), F.lit("]")), F.lit(None).cast("string"), v))
    return F.coalesce(fields.cast(_CHILDREN), elements.cast(_CHILDREN))


def nodes(rows: DataFrame, by: list[str], json: Column, deepest: int = 90) -> DataFrame:
    """(by, path, parent, key, depth, value): every node; key is NULL for the root and for elements of an array.

    Nodes below ``deepest`` levels are not entered. How deep the deepest document is, is asked first.
    """
    texts = rows.select(*by, json.alias("__json"))
    deep = texts.agg(F.max(levels(F.col("__json")))).first()[0] or 0  # one number
    root = F.struct(F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("depth"), F.col("value"))
    walked = texts.select(*by, F.try_parse_json("__json").alias("value")).where("value is not null").select(*by, root.alias("n"))
    for level in range(min(deep, deepest)):
        own = F.array(F.col("n")).cast(_CHILDREN)
        met = F.when(F.col("n.depth") == level, F.concat(own, F.coalesce(_children(F.col("n")), F.array().cast(_CHILDREN)))).otherwise(own)
        walked = walked.select(*by, F.explode(met).alias("n"))
    return walked.select(*by, "n.*")


def under_key(found: DataFrame, wanted: Column) -> DataFrame:
    """Nodes whose key satisfies a condition on ``key``, at any depth; what lies below one of them is a node of its own."""
    return found.where(F.col("key").isNotNull() & wanted)


def holders(found: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, path) of the objects that hold an object under ``key``; of a document's several the shallowest, then the first by path."""
    held = found.where((F.col("key") == key) & F.startswith(F.schema_of_variant("value"), F.lit("OBJECT")))
    return held.groupBy(*by).agg(F.min_by("parent", F.struct("depth", "path")).alias("path"))


def series(found: DataFrame, by: list[str], block: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(by, series, ms, value): the points ``{epoch ms: number}`` of named objects right under each document's ``block`` (by, path)."""
    names = F.create_map(*[F.lit(x) for kv in keys.items() for x in kv])
    under = block.select(*by, F.explode(F.array(*[F.lit(k) for k in keys])).alias("__key"), F.col("path").alias("__block"))
    under = under.select(*by, F.concat("__block", F.lit("."), "__key").alias("parent"), F.element_at(names, F.col("__key")).alias("series"))
    points = found.where(F.col("key").rlike("^[0-9]+$")).join(under, [*by, "parent"])
    return points.select(*by, "series", F.col("key").cast("long").alias("ms"), F.try_variant_get("value", "$", "double").alias("value")).where("value is not null")


def state_nodes(pages: DataFrame, by: list[str], html: str, name: str = "__STATE__") -> DataFrame:
    """Nodes of the state that each page carries in a script."""
    return nodes(pages, by, state_blob(F.col(html), name))
