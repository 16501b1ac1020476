"""Template decontamination: verbatim, re-parameterised and inconsistent copies of benchmark items."""

from __future__ import annotations

import random
import re

import pytest

from finsheet.llm.decontaminate import NUMBER_WORDS, UNITS, contaminated, drop_contaminated

ITEM = "a train leaves the station with 40 passengers and after 25 minutes it has met Alice who paid 40 dollars for the very same ticket as before"
OTHER = "there are twelve large baskets in the kitchen and every basket holds exactly seven ripe apples from the old garden"


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, ITEM, "x"), (2, OTHER, "y"), (3, None, "z"), (4, "", "z"), (5, "of the people by the people", "z"), (6, "12 13 14", "z")]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


DOCS = [
    (10, f"Before it. {ITEM}. And after it comes more text that has nothing to do with it"),
    (11, ITEM.replace("40", "73").replace("25", "31").replace("Alice", "Berta")),
    (12, ITEM.replace("40 passengers", "73 passengers").replace("25", "31")),  # 40 stands for 73 and for 40: inconsistent
    (13, "A quite different text about trains and stations and tickets and passengers"),
    (14, None),
    (15, ""),
    (16, OTHER.upper()),
    (17, " ".join(OTHER.split()[:14]) + " and something else entirely follows here"),
    (18, "so it said of the people by the people once"),
    (19, "word " * 5000 + ITEM + " word" * 5000),
    (20, "12 13 14"),
]


@pytest.fixture(scope="module")
def found(spark, benchmark):
    docs = spark.createDataFrame([(i, t, i) for i, t in DOCS], "doc_id long, text string, item_id int")
    return docs, {(r.doc_id, r.item_id): r.kind for r in contaminated(docs, benchmark).collect()}


def test_copies_are_found_and_clean_texts_left(found):
    assert {k for k in found[1]} == {(10, 1), (11, 1), (16, 2), (17, 2), (18, 5), (19, 1)}


def test_kinds(found):
    assert found[1][10, 1] == "verbatim" and found[1][11, 1] == "reparameterised"


def test_unfiltered_join_gives_the_same(found, benchmark):
    docs, kinds = found
    assert {(r.doc_id, r.item_id): r.kind for r in contaminated(docs, benchmark, filter_limit=0).collect()} == kinds


def test_clean_documents_stay_whole(found, benchmark):
    docs = found[0]
    assert sorted(drop_contaminated(docs, benchmark).collect(), key=lambda r: r.doc_id) == [r for r in sorted(docs.collect(), key=lambda r: r.doc_id) if r.doc_id in (12, 13, 14, 15, 20)]


def test_every_item_is_found_in_itself_and_nowhere_in_other_words(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = items.selectExpr("item_id + 1000 AS doc_id", "concat('Some words first. ', text, ' Some words last.') AS text")
    hits = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    ids = [r.item_id for r in items.select("item_id").collect()]
    assert {(i + 1000, i) for i in ids} <= hits


def test_empty_tables(spark, benchmark, empty):
    assert contaminated(empty, benchmark).count() == 0
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert contaminated(docs, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("item", "text"),
    [
        ("Mr Smith and Anna walk 4 km to Paris and then 12 km to Rome with Bob", "Mr Jones and Clara walk 5 km to Lyon and then 13 km to Nice with Tom"),
        ("Mr Smith and Anna walk 4 km to Paris and then 12 km to Rome with Bob", "Mr Jones and Clara walk 5 km to New York and then 13 km to Los Angeles with Tom"),
        ("Mr Smith and Anna walk 4 km to Paris and then 12 km to Rome with Bob", "Mr Jones and Clara walk 5.5 km to Lyon and then 1,250.75 km to Nice with Tom"),
        ("a shop sells 1,250 pens at 3.5 euros each to Anna Maria Lopez and 7 more to Bob", "a shop sells 90 pens at 4 euros each to Peter and 12.25 more to Mary Ann Smith"),
    ],
)
def test_numbers_and_names_of_several_words(spark, item, text):
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"It was so. {text}. and after it"), (2, "nothing of the kind is said here, by anyone, at any length at all")], "doc_id long, text string")
    rows = contaminated(docs, items).collect()
    assert [(r.doc_id, r.kind) for r in rows] == [(1, "reparameterised")] and rows[0].coverage == 1.0


def test_values_must_go_together(spark):
    items = spark.createDataFrame([(1, "we take 4 km to Paris and 4 km back from Paris to where we were before")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "we take 9 km to New York and 9 km back from New York to where we were before"), (2, "we take 9 km to New York and 8 km back from San Diego to where we were before")], "doc_id long, text string")
    assert [r.doc_id for r in contaminated(docs, items).where("coverage = 1").collect()] == [1]


def tokens(text, names=True):
    """[(token, value or None)] by one word after the other."""
    words, out, last = list(re.finditer("[0-9A-Za-z_\x80-\U0010ffff]+", text)), [], None
    for i, m in enumerate(words):
        w, low = m[0], m[0].lower()
        before = words[i - 1] if i else None
        gap = text[before.end() : m.start()] if before else None
        digits = w[0].isdigit() and w[0].isascii()
        number = digits or low in NUMBER_WORDS
        name = names and not number and len(w.encode()) > 1 and w[0] != low[0] and w[1:] == low[1:]
        unit = bool(before) and (before[0][0].isdigit() or before[0].lower() in NUMBER_WORDS) and not number and not name and low in UNITS
        kind = "number" if number else "name" if name else "unit" if unit else None
        glued = last == ("digits" if digits else kind) and ((digits and gap in (",", ".")) or (name and gap in (" ", "-")))
        if glued:
            out[-1] = (out[-1][0], (*out[-1][1], low))
        else:
            out.append((f"<{kind}>", (low,)) if kind else (low, None))
        last = "digits" if digits else kind
    return out


def brute(docs, items, window=8, least=4, coverage=0.3):
    """{(doc, item): (windows, coverage, kind)} by comparing every window of every document with every one of every item."""
    found = {}
    for i, item, reading in [(i, item, reading) for i, item in items for reading in (True, False)]:
        own = tokens(item, reading)
        if not reading and not any(t == "<name>" for t, _ in tokens(item)):
            continue
        n = min(window, len(own))
        cut = lambda t, n: [(p, t[p : p + n]) for p in range(len(t) - n + 1) if sum(v is None for _, v in t[p : p + n]) >= min(least, n)]
        mine = cut(own, n) if n >= min(least, window) else []
        for d, text in docs:
            lines = {}
            for p, w in cut(tokens(text), n):
                for q, v in mine:
                    if [x for x, _ in w] == [x for x, _ in v]:
                        at, pairs = lines.setdefault(p - q, (set(), set()))
                        at.add(q)
                        pairs |= {(b, a) for (_, a), (_, b) in zip(w, v, strict=True) if b is not None}
            good = [(at, pairs) for at, pairs in lines.values() if len(pairs) == len({b for b, _ in pairs}) == len({a for _, a in pairs})]
            windows = set().union(*[at for at, _ in good])
            if good and len(windows) / len(mine) >= max(coverage, found.get((d, i), (0, 0))[1] + 1e-9 * (not reading)):
                found[d, i] = len(windows), round(len(windows) / len(mine), 9), "verbatim" if all(a == b for _, pairs in good for a, b in pairs) else "reparameterised"
    return found


def test_against_every_window_of_every_text(spark):
    """Items with numbers, units and names anywhere, also at the start of sentences; copies with other values, cut short or inconsistent."""
    rng = random.Random(11)
    plain = "the train leaves a small red station and meets old friends who pay for more tickets than before while it rains on green hills".split()
    names, units = ["Alice", "Bob", "Clara", "New York", "São Paulo", "Émile"], ["km", "minutes", "dollars"]

    def shape():
        out = []
        for _ in range(rng.randrange(3, 40)):
            out.append(rng.choice(["w", "w", "w", "w", "n", "u", "a", "."]) + str(rng.randrange(3)))
        return [rng.choice(plain) if x[0] == "w" else x for x in out]

    def text(form, values):
        words, opens = [], True
        for x in form:
            kind = x if re.fullmatch(r"[nua.]\d", x) else None
            if kind and kind[0] == ".":
                words, opens = [*words[:-1], words[-1] + "."] if words else words, True
                continue
            w = {"n": lambda: values[kind], "u": lambda: f"{values['n' + kind[1]]} {units[int(kind[1])]}", "a": lambda: values[kind]}[kind[0]]() if kind else x
            words.append(w.capitalize() if opens and not kind else w)
            opens = False
        return " ".join(words)

    draw = lambda: {**{f"n{k}": rng.choice([str(rng.randrange(2, 900)), "1,250.5", "seven", "Twelve"]) for k in range(3)}, **dict(zip(("a0", "a1", "a2"), rng.sample(names, 3), strict=True))}
    forms = [shape() for _ in range(25)]
    items = [(i, text(f, draw())) for i, f in enumerate(forms)]
    docs = []
    for i, f in enumerate(forms):
        docs += [(10 * i, items[i][1]), (10 * i + 1, f"Some say so. {text(f, draw())} And more"), (10 * i + 2, text(f[: len(f) // 2], draw()) + " " + text(shape(), draw())), (10 * i + 3, text(f, draw()) + " " + text(f, draw())), (10 * i + 4, items[i][1].upper()), (10 * i + 5, "so it says: " + items[i][1].lower() + " and no more")]
    got = {(r.doc_id, r.item_id): (r.n_windows, round(r.coverage, 9), r.kind) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert got == want and {k for *_, k in want.values()} == {"verbatim", "reparameterised"}


def test_a_changed_problem_of_three_sentences_is_covered_whole(spark):
    item = "Alice buys 12 red apples at the market on the hill. Bob gives her three more of them before noon. Paris is where they eat all of the apples together with friends."
    copy = "Clara buys 30 red apples at the market on the hill. David gives her five more of them before noon. Rome is where they eat all of the apples together with friends."
    rows = contaminated(spark.createDataFrame([(1, copy)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.kind, r.coverage) for r in rows] == [("reparameterised", 1.0)]
