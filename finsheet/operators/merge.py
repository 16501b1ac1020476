"""Deep merge of nested records by their schema: what a later batch adds fills what earlier ones left empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from finsheet.functions.coerce import bound
from finsheet.functions.text import squeeze


class Keyed:
    """How the elements of an array of structs are one: by fields, whose text is compared without case and outer blanks.

    ``merge``: elements of one key become one, merged field by field. Otherwise elements are appended, those with a key that an
    earlier record has are left out, and those without a key all stay.
    """

    def __init__(self, *fields: str, merge: bool):
        self.fields, self.merge = fields, merge

    def of(self, element: Column) -> Column:
        return F.struct(*[F.coalesce(squeeze(element[f].cast("string")), F.lit("")).alias(f) for f in self.fields])

    def none(self, element: Column) -> Column:
        held = F.lit(True)
        for f in self.fields:
            held = held & element[f].isNull()
        return held


def in_order(rows: Column) -> Column:
    """The field ``r`` of an array of (o, r), by ``o``; ``r`` may be of a type that has no order, such as a map."""
    less = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    return F.transform(F.array_sort(rows, less), lambda x: x["r"])


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def merged(values: Column, kind: DataType, keyed: dict[str, Keyed], path: str = "") -> Column:
    """One value of type ``kind`` from an array of them in order: structs and maps field by field, at any depth; else the first that is there.

    What several fields or elements read is bound once: nothing else is shared inside lambdas, so it would be made again for each of them.
    """
    at = lambda name: f"{path}.{name}" if path else name
    field = lambda name: lambda v: v[name]

    def struct(there: Column) -> Column:
        fields = [merged(F.transform(there, field(f.name)), f.dataType, keyed, at(f.name)).alias(f.name) for f in kind.fields]
        return F.when(F.size(there) > 0, F.struct(*fields))

    def by_key(there: Column) -> Column:
        keys = F.array_distinct(F.flatten(F.transform(there, F.map_keys)))
        pairs = F.transform(keys, lambda k: F.struct(k.alias("key"), merged(F.transform(there, lambda v: F.try_element_at(v, k)), kind.valueType, keyed, at("*")).alias("value")))
        return F.when(F.size(there) > 0, F.map_from_entries(pairs))

    def by_fields(there: Column, how: Keyed) -> Column:
        every = F.transform(F.filter(F.flatten(there), lambda e: e.isNotNull()), lambda e: F.struct(how.of(e).alias("k"), e.alias("e")))
        of_key = lambda every, k: F.transform(F.filter(every, lambda t: t["k"] == k), field("e"))
        each = lambda every: F.transform(F.array_distinct(F.transform(every, field("k"))), lambda k: merged(of_key(every, k), kind.elementType, keyed, path + "[]"))
        return F.when(F.size(there) > 0, bound(every, each))

    def appended(there: Column, how: Keyed) -> Column:
        marked = lambda v: F.transform(v, lambda e: F.struct(how.of(e).alias("k"), how.none(e).alias("free"), e.alias("e")))
        added = lambda held, more: F.concat(held, F.filter(more, lambda t: t["free"] | ~F.exists(held, lambda h: h["k"] == t["k"])))
        fold = lambda every: F.transform(F.aggregate(every, F.slice(F.flatten(every), 1, 0), added), field("e"))
        return F.when(F.size(there) > 0, bound(F.transform(there, marked), fold))

    there = F.filter(values, lambda v: v.isNotNull())
    if isinstance(kind, StructType):
        return bound(there, struct)
    if isinstance(kind, MapType):
        return bound(there, by_key)
    if isinstance(kind, ArrayType) and path in keyed:
        return bound(there, lambda held: (by_fields if keyed[path].merge else appended)(held, keyed[path]))
    return _first(values)


def merge_records(batches: DataFrame, by: list[str], order: list[str], keyed: dict[str, Keyed]) -> DataFrame:
    """One record of each group from its batches in ``order``; ``keyed`` names arrays by their path, ``[]`` standing for an element.

    A group is the batches of one filing.
    """
    fields = [f for f in batches.schema.fields if f.name not in (*by, *order)]
    record = F.struct(*[F.col(f"`{f.name}`") for f in fields])
    grouped = batches.groupBy(*by).agg(in_order(F.collect_list(F.struct(F.struct(*order).alias("o"), record.alias("r")))).alias("__records"))
    whole = merged(F.col("__records"), StructType(fields), keyed)
    return grouped.select(*by, F.inline(F.array(whole)))
