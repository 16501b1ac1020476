"""Benchmark decontamination by template windows.

A text is read as a template: numbers, names and the units that follow numbers become typed placeholders, every other
word is itself in lower case. A number is digits, with its separators (1,250.75), or a number word; a name is a word, or several
(New York), in lower case but for its first letter. The first word of a sentence is read so too, as nothing tells whether it is
a name: it is a placeholder in the item and in its copies alike, and must go together like the others. The value of a
placeholder is all of it. Items that hold names are read a second time without any, for copies in capitals or in lower case
throughout, which show none; an item counts as found by the reading that covers more of it. Windows of ``window`` template tokens of the documents are hash-joined with those of
the benchmark items (an item shorter than that is one window of all its tokens). Windows are compared by
two independent 64-bit hashes of their tokens. Where windows line up, the values
behind the placeholders must go together one to one: the same item value always meets the same document value and the
other way round. An item is found in a document when windows of consistent alignments cover at least
``coverage`` of the item; with equal values it is ``verbatim``, else ``reparameterised``.

The benchmark's window hashes go to every task as a filter while there are at most ``filter_limit`` of them; beyond
that the documents' windows are shuffled to the join as they are, with the same result.

Defined cases: null and empty texts and items have no windows and are never found; windows of fewer than
``min_literal`` plain words are not used (a benchmark item of nothing else cannot be found); repeated items are found
each; repeated documents are reported by id; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsheet.llm.common import materialise
from finsheet.llm.kernel import mix, pieces, prefix_hash, span_hash, string_buffers, window_hash, word_spans

#: Words that are units when a number stands before them.
UNITS = (
    "kg g mg lb lbs oz ton tons tonne tonnes km m cm mm mile miles foot feet ft inch inches yard yards l ml litre litres liter liters gallon gallons "
    "second seconds sec minute minutes min hour hours hr day days week weeks month months year years dollar dollars euro euros cent cents pound pounds "
    "percent degree degrees celsius fahrenheit volt volts watt watts joule joules newton newtons pascal hz mph kph euros eur usd"
).split()

#: Number words.
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PLACE = np.uint64(0xD1B54A32D192ED03)
_CHECK = np.uint64(0x8CB92BA72F3D8DD7)
NUMBER, NAME, UNIT = mix(np.array([11, 12, 13], dtype=np.uint64))


def _fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, byte by byte."""
    out = _FOLD[data]
    if len(data) > 1:
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[latin] += 32
    return out


def _word_hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return mix(span_hash(prefix_hash(data), np.array([0]), np.array([len(data)])))[0]


_UNIT_HASHES = np.array([_word_hash(u) for u in UNITS], dtype=np.uint64) | np.uint64(1)
_NUMBER_HASHES = np.array([_word_hash(u) for u in NUMBER_WORDS], dtype=np.uint64) | np.uint64(1)


def template(texts: pa.Array, names: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template token hashes, hashes of the values behind placeholders or 0, offsets by text)."""
    data, offsets = string_buffers(texts)
    starts, ends = word_spans(data, offsets)
    low = _fold(data)
    own = mix(span_hash(prefix_hash(low), starts, ends)) | np.uint64(1)
    first = np.searchsorted(starts, offsets)
    digits = (data[starts] >= 48) & (data[starts] <= 57) if len(starts) else np.zeros(0, dtype=bool)
    number = digits | np.isin(own, _NUMBER_HASHES)
    changed = np.concatenate([[0], np.cumsum(low != data)])
    upper = changed[ends] - changed[starts]
    head = (low[starts] != data[starts]) | ((data[starts] == 0xC3) & (low[np.minimum(starts + 1, len(data) - 1)] != data[np.minimum(starts + 1, len(data) - 1)])) if len(starts) else number
    name = head & (upper == 1) & (ends - starts > 1) & ~number & names
    after = np.zeros(len(starts), dtype=bool)
    after[1:] = number[:-1]
    unit = after & ~number
    unit[unit] = np.isin(own[unit], _UNIT_HASHES)
    token = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, own)))
    # Words one byte apart go together: digits around a separator, capitalised words around a blank or dash.
    glued = np.zeros(len(starts), dtype=bool)
    if len(starts) > 1:
        gap = np.where(starts[1:] - ends[:-1] == 1, data[np.minimum(ends[:-1], len(data) - 1)], 0)
        glued[1:] = (digits[1:] & digits[:-1] & ((gap == 44) | (gap == 46))) | (name[1:] & name[:-1] & ((gap == 32) | (gap == 45)))
        glued[first[:-1][first[:-1] < len(starts)]] = False
    heads = np.flatnonzero(~glued)
    if not len(heads):
        return token, np.zeros(0, dtype=np.uint64), first
    place = (np.arange(len(starts)) - np.repeat(heads, np.diff(np.append(heads, len(starts))))).astype(np.uint64)
    value = np.add.reduceat(mix(own + place * _PLACE), heads) | np.uint64(1)
    before_word = np.concatenate([[0], np.cumsum(~glued)])
    return token[heads], np.where((number | name | unit)[heads], value, np.uint64(0)), before_word[first]


def windows(texts: pa.Array, lengths: list[int], min_literal: int, names: bool = True) -> tuple[np.ndarray, ...]:
    """(text, position, hash, length, first token, second hash) of all windows of the given lengths, and the values of all tokens."""
    token, value, first = template(texts, names)
    count = np.diff(first)
    literal = np.concatenate([[0], np.cumsum(value == 0)])
    parts = []
    for n in lengths:
        doc = np.repeat(np.arange(len(count)), np.maximum(0, count - n + 1))
        if not len(doc):
            continue
        size = np.maximum(0, count - n + 1)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + first[doc]
        at_doc = at - first[doc]
        good = literal[at + n] - literal[at] >= min(min_literal, n)
        parts.append((doc[good], at_doc[good], window_hash(token, n)[at[good]] + np.uint64(n), np.full(good.sum(), n), at[good], window_hash(mix(token ^ _CHECK), n)[at[good]]))
    if not parts:
        return (*[np.zeros(0, dtype=np.int64)] * 2, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), value)
    return (*[np.concatenate([p[i] for p in parts]) for i in range(6)], value)


WINDOWS = "id long, pos int, hash long, again long, slots array<long>"


def _rows(ids, found: tuple[np.ndarray, ...], keep: np.ndarray) -> pa.RecordBatch:
    doc, pos, hashes, n, at, again, value = found
    slots = [value[a : a + k].view(np.int64).tolist() if value[a : a + k].any() else [] for a, k in zip(at[keep].tolist(), n[keep].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(doc[keep])), pa.array(pos[keep], pa.int32()), pa.array(hashes[keep].view(np.int64)), pa.array(again[keep].view(np.int64)), pa.array(slots, pa.list_(pa.int64()))], names=["id", "pos", "hash", "again", "slots"])


def item_windows(benchmark: DataFrame, window: int, min_literal: int) -> DataFrame:
    """Windows of the items, with reading 0 (names) and, for items that hold names, 1 (none); an item shorter than ``window`` tokens is one window of its own length."""

    def cut(batches):
        for batch in pieces(batches):
            texts = batch.column("text")
            plain = [template(texts, names)[2] for names in (True, False)]
            tokens = [template(texts, names)[0] for names in (True, False)]
            for reading, names in enumerate((True, False)):
                found = windows(texts, list(range(1, window + 1)), min_literal, names)
                count = np.diff(plain[reading])[found[0]]
                keep = (found[3] == np.minimum(count, window)) & (found[3] >= min(min_literal, window))
                if reading:
                    named = np.concatenate([[0], np.cumsum(tokens[0] == NAME)])[plain[0]]
                    keep &= (np.diff(named) > 0)[found[0]]
                rows = _rows(batch.column("id"), found, np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, reading, dtype=np.int32))], names=[*rows.schema.names, "reading"])

    own = benchmark.select(F.col("item_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    return own.mapInArrow(cut, f"{WINDOWS}, reading int")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_literal: int = 4, coverage: float = 0.3, filter_limit: int = 2_000_000) -> DataFrame:
    """Per document and item found in it: doc_id, item_id, n_windows, coverage, n_slots, kind."""
    items = materialise(item_windows(benchmark, window, min_literal), "items")
    total = items.count()
    known = None
    if total <= filter_limit:  # checked: at most 8 bytes each
        known = docs.sparkSession.sparkContext.broadcast(np.unique(np.array([r.hash for r in items.select("hash").distinct().collect()], dtype=np.int64).view(np.uint64)))
    shortest = max(1, min(min_literal, window))

    def scan(batches):
        for batch in pieces(batches):
            found = windows(batch.column("text"), list(range(shortest, window + 1)) if short else [window], min_literal)
            keep = np.arange(len(found[0]))
            if known is not None:
                have = known.value
                at = np.minimum(np.searchsorted(have, found[2]), max(0, len(have) - 1))
                keep = np.flatnonzero(have[at] == found[2]) if len(have) else keep[:0]
            yield _rows(batch.column("id"), found, keep)

    sizes = items.groupBy(F.col("id").alias("item_id"), "reading").agg(F.countDistinct("pos").alias("of"))
    short = bool(items.groupBy("id", "reading").count().where("count = 1").limit(1).count())
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    hits = own.mapInArrow(scan, WINDOWS)
    side = items.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "hash", "again", "reading", F.col("slots").alias("item_slots"))
    met = hits.join(side, ["hash", "again"]).select(
        F.col("id").alias("doc_id"), "item_id", "reading", "item_pos", (F.col("pos") - F.col("item_pos")).alias("line_up"),
        F.filter(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda p: p["i"] != 0).alias("pairs"),
    )
    aligned = met.groupBy("doc_id", "item_id", "reading", "line_up").agg(F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    one_to_one = (F.size("pairs") == F.size(F.array_distinct(F.col("pairs.i")))) & (F.size("pairs") == F.size(F.array_distinct(F.col("pairs.d"))))
    aligned = aligned.where(one_to_one).withColumn("same", F.forall("pairs", lambda p: p["i"] == p["d"]))
    found = aligned.groupBy("doc_id", "item_id", "reading").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n_windows"), F.max(F.size("pairs")).alias("n_slots"), F.min("same").alias("same"))
    covered = found.join(sizes, ["item_id", "reading"]).withColumn("coverage", F.col("n_windows") / F.col("of")).where(F.col("coverage") >= coverage)
    best = covered.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_windows", "coverage", "n_slots", "same"), F.struct("coverage", -F.col("reading"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_windows").cast("long").alias("n_windows"), "b.coverage", F.col("b.n_slots").cast("int").alias("n_slots"), F.when(F.col("b.same"), "verbatim").otherwise("reparameterised").alias("kind"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents in which no benchmark item is found, whole and with their columns; null ids are kept."""
    gone = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
