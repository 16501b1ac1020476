"""Many patterns over many pages in one pass: a landed table of patterns, their literals in one automaton.

Every pattern is read once for the literals that any match of it must hold. An automaton of all literals walks over a page; only
the patterns of which a literal occurs are then run as expressions, so a page costs one walk and a few searches, however
many patterns there are. A pattern that must hold no literal is always run.
"""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

#: Most patterns of a table; they go to every task.
MOST = 20_000


def required_literals(pattern: str) -> list[str] | None:
    """Literals of which every match holds at least one (the longest of each alternative), or None where that is not plain."""
    found: list[str] = []
    run, best, i, n = "", "", 0, len(pattern)

    def ended(keep_last: bool = True) -> None:
        nonlocal run, best
        run = run if keep_last else run[:-1]
        best, run = (run if len(run) > len(best) else best), ""

    while i < n:
        c = pattern[i]
        if c == "(":  # what a group holds may be repeated or left out: it only ends the run
            depth, i = 1, i + 1
            if pattern[i : i + 1] == "?" and pattern[i + 1 : i + 2] not in (":", "="):
                return None  # flags and look-arounds
            while i < n and depth:
                if pattern[i] == "\\":
                    i += 1
                elif pattern[i] == "[":
                    i = _class_end(pattern, i) - 1
                depth += {"(": 1, ")": -1}.get(pattern[i : i + 1], 0)
                i += 1
            ended()
            continue
        if c == "[":
            i = _class_end(pattern, i)
            ended()
            continue
        if c == "|":
            ended()
            found.append(best)
            best = ""
        elif c in "*?{":
            ended(keep_last=False)
            if c == "{":
                i = pattern.index("}", i)
        elif c in "+.^$":
            ended()
        elif c == "\\":
            i += 1
            if pattern[i].isalnum():
                ended()
            else:
                run += pattern[i]
        else:
            run += c
        i += 1
    ended()
    found.append(best)
    return found if all(found) else None


def _class_end(pattern: str, i: int) -> int:
    """Where the character class that opens at ``i`` is over."""
    i += 2 if pattern[i + 1 : i + 2] == "^" else 1
    if pattern[i : i + 1] == "]":
        i += 1
    while pattern[i] != "]":
        i += 2 if pattern[i] == "\\" else 1
    return i + 1


class Matcher:
    """A table of (tier, pattern) in order, ready to be sent to tasks; the automaton is built where it is used."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.rows = rows
        self._ready = None

    def __getstate__(self):
        return {"rows": self.rows, "_ready": None}

    def _built(self):
        if self._ready is None:
            automata, always = {True: ahocorasick.Automaton(), False: ahocorasick.Automaton()}, []
            for at, (_, pattern) in enumerate(self.rows):
                literals = required_literals(pattern)
                if literals is None:
                    always.append(at)
                for literal in literals or []:
                    automaton = automata[pattern.isascii()]
                    automaton.add_word(literal, [*automaton.get(literal, []), at])
            for automaton in automata.values():
                if len(automaton):
                    automaton.make_automaton()
            self._ready = automata, always, [re.compile(p) for _, p in self.rows]
        return self._ready

    def hits(self, text: str | None) -> dict[str, list[str]]:
        """First match, trimmed, of each pattern that matches, by tier and in order; plain patterns see lower case, others the text itself."""
        out: dict[str, list[str]] = {}
        if not text:
            return out
        automata, always, compiled = self._built()
        seen, found = {True: text.lower(), False: text}, set(always)
        for plain, automaton in automata.items():
            if len(automaton):
                for _, ats in automaton.iter(seen[plain]):
                    found.update(ats)
        for at in sorted(found):
            tier, pattern = self.rows[at]
            if (met := compiled[at].search(seen[pattern.isascii()])) and met.group():
                out.setdefault(tier, []).append(met.group().strip())
        return out


def matcher(patterns: DataFrame, tier: str = "tier", order: str = "pos", pattern: str = "pattern") -> Matcher:
    """The landed table of patterns, in order; it must not have more than MOST rows."""
    rows = patterns.select(tier, pattern, order).where(F.col(pattern).isNotNull() & (F.col(pattern) != "")).orderBy(order, tier, pattern).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} patterns")
    return Matcher([(r[0], r[1]) for r in rows])


def pattern_hits(text: Column, found: Matcher) -> Column:
    """Tier to its hits, as a map; evaluated once a row wherever it is named."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(found.hits)

    return F.pandas_udf(each, MapType(StringType(), ArrayType(StringType()))).asNondeterministic()(text)


def tiers_of(hits: Column, names: tuple[str, ...]) -> dict[str, Column]:
    """The hits of each named tier; a tier without any is empty."""
    return {k: F.coalesce(F.try_element_at(hits, F.lit(k)), F.array().cast("array<string>")) for k in names}
