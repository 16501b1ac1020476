"""Deep merges against a merge by recursion, and sums inside JSON texts."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from finsheet.functions import coerce
from finsheet.operators.merge import Keyed, merge_records, merged
from finsheet.sources.readers import loose_json

SCHEMA = "f string, batch int, company string, plans array<struct<name:string,type:string,closing:double,inputs:struct<rate:double,more:struct<x:int,y:int>>,notes:map<string,int>,tranches:array<struct<day:string,n:int>>>>, tags array<string>"
KEYED = {"plans": Keyed("name", "type", merge=True), "plans[].tranches": Keyed("day", merge=False)}


def deep(a, b):
    if isinstance(a, dict) or isinstance(b, dict):
        a, b = a or {}, b or {}
        return {k: deep(a.get(k), b.get(k)) for k in [*a, *[k for k in b if k not in a]]}
    return b if a is None else a


def brute(records):
    out, plans, any_plans = {}, {}, False
    for r in records:
        out = deep(out, {k: v for k, v in r.items() if k != "plans"})
        any_plans |= r["plans"] is not None
        for p in r["plans"] or []:
            key = tuple((p[k] or "").strip().lower() for k in ("name", "type"))
            if key not in plans:
                plans[key] = p
                continue
            have = plans[key]
            tranches = have["tranches"]
            if p["tranches"] is not None:
                seen = {t["day"] for t in tranches or []}
                tranches = (tranches or []) + [t for t in p["tranches"] if t["day"] is None or t["day"] not in seen]
            plans[key] = {**deep(have, p), "tranches": tranches}
    return {**out, "plans": list(plans.values()) if any_plans else None}


def test_nested_records_merge_field_by_field(spark):
    rng = random.Random(3)
    maybe = lambda v: v if rng.random() < 0.6 else None
    plan = lambda: {"name": rng.choice(["A", " a", "B", None]), "type": rng.choice(["RSU", "rsu ", "X"]), "closing": maybe(rng.random()), "inputs": maybe({"rate": maybe(rng.random()), "more": maybe({"x": maybe(rng.randrange(9)), "y": maybe(rng.randrange(9))})}), "notes": maybe({rng.choice("pqr"): rng.randrange(9)}), "tranches": maybe([{"day": rng.choice(["d1", "d2", None]), "n": rng.randrange(9)} for _ in range(rng.randrange(3))])}
    groups = {f"f{i}": [{"company": maybe("C"), "plans": maybe([plan() for _ in range(rng.randrange(4))]), "tags": maybe(["t"])} for _ in range(rng.randrange(1, 6))] for i in range(40)}
    rows = [(f, i, r["company"], [tuple({**p, "inputs": p["inputs"] and (p["inputs"]["rate"], p["inputs"]["more"] and tuple(p["inputs"]["more"].values())), "tranches": p["tranches"] and [tuple(t.values()) for t in p["tranches"]] if p["tranches"] != [] else []}.values()) for p in r["plans"]] if r["plans"] is not None else None, r["tags"]) for f, rs in groups.items() for i, r in enumerate(rs)]
    rng.shuffle(rows)
    got = {r.f: r.asDict(recursive=True) for r in merge_records(spark.createDataFrame(rows, SCHEMA), ["f"], ["batch"], KEYED).collect()}
    plain = lambda v: {k: plain(x) for k, x in v.items() if plain(x) is not None} or None if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else v
    for f, records in groups.items():
        want = brute(records)
        assert plain({k: v for k, v in got[f].items() if k != "f"}) == plain(want), f


def test_keys_of_elements_are_made_once_however_many_fields_are_merged(spark):
    """Lambdas share nothing by themselves: a key named for each field is made again for each field of each element."""
    element = lambda n: "struct<" + ",".join(["name:string", *[f"x{i}:struct<y:int,z:int>" for i in range(n)]]) + ">"
    made = [str(merged(F.col("v"), ArrayType(StructType.fromDDL(f"e {element(n)}")[0].dataType), {"": Keyed("name", merge=True)})).count("regexp_replace") for n in (1, 10)]
    assert made[0] == made[1] > 0


@pytest.mark.parametrize(
    ("raw", "value"),
    [
        ('{"a": 178281 + 801709 + 89846}', {"a": 1069836}), ('{"a": 532 + -34292, "b": [1 - - 2, 3]}', {"a": -33760, "b": [3, 3]}), ('{"a": "1 + 2", "b": "x: 3 + 4"}', {"a": "1 + 2", "b": "x: 3 + 4"}), ('{"a": 1,234.5 + 0.5}', {"a": 1235}),
        ('{"a": 0.1 + 0.25}', {"a": 0.35}), ('{"a": -5, "b": 1e-5}', {"a": -5, "b": 1e-5}), ('{"q\\"1 + 1": 2 ++ 3 -+ 1}', {'q"1 + 1': 4}), ("[1 + 1]", [2]), ("{}", {}), (r'{"a": "\\", "b": 1 + 1}', {"a": "\\", "b": 2}),
    ],
)
def test_sums_inside_json(spark, raw, value):
    fixed = spark.createDataFrame([(raw,)], "x string").select(coerce.json_sums("x")).first()[0]
    assert json.loads(fixed) == value


def test_long_strings_and_nulls(spark):
    long = json.dumps({"a": "x1 + 1\\\"" * 50_000})
    out = [r[0] for r in spark.createDataFrame([(long,), (None,), ("",), ('"open: 1 + 2',)], "x string").select(coerce.json_sums("x")).collect()]
    assert out == [long, None, "", '"open: 1 + 2'] or out[:3] == [long, None, ""]


def test_answers_with_sums_and_curly_quotes(spark):
    rows = [("Sure: {“a”: 1 + 2,}",), ('```json\n{"a": 5}\n```',), ("no",)]
    out = spark.createDataFrame(rows, "x string").select(loose_json(F.col("x")).alias("j")).collect()
    assert [r.j and json.loads(r.j) for r in out] == [{"a": 3}, {"a": 5}, None]


@pytest.mark.parametrize(("raw", "number"), [("5 -- 3", 8), ("5 ++ 3", 8), ("5 -+ 3", 2), ("5 + - - 3", 8)])
def test_sign_runs(spark, raw, number):
    assert spark.createDataFrame([(raw,)], "x string").select(coerce.tally_number("x")).first()[0] == number
