"""Suffix-array deduplication of byte strings by a suffix sort inside content-anchored segments.

Every byte of a document that lies in a string of ``length`` bytes which also starts in a document with a smaller id
is removed. All strings of that length are covered, none is sampled away:

1. Each string has an anchor: of its ``gram``-byte grams the one of smallest hash. Consecutive strings of a text
   mostly share their anchor, so a text falls into segments (a run of starts with one anchor), about one for every
   16 bytes. Equal strings have equal anchors. Documents are dealt into groups of a few MB; each group names its anchors
   once, whatever the number of its documents that have them, and learns which of them other documents have, too.
2. The segments of those anchors are cut from the texts. In a group equal segments are one, with the smallest id that
   has it; their occurrences stay with the group, so that a passage of a third of all documents is one row a group.
3. Where the segments of an anchor differ, the suffixes that start in them are sorted by their first ``length`` bytes: a
   round sorts those that are still tied by their next bytes, as many as fit beside the tie's number into 64 bits, so
   that strings which are tied at the end are equal byte by byte. Segments of equal hash are compared byte by byte, too,
   so a hash collision cannot join them. Each class of equal strings knows the smallest id that has it.
4. The smallest ids go back to the groups, where removed runs are merged and cut out.

Defined cases: a null text is the empty text; a text shorter than ``length`` loses nothing; repeated strings inside
one document do not count; documents of equal id do not count against each other, each keeps its own text (a hash of the
text tells them apart), and equal rows get equal results; a document without an id neither loses bytes nor costs others
any; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsheet.llm.common import drop, materialise, scaled_partitions
from finsheet.llm.kernel import INVERSE, mix, pieces, powers, prefix_hash, string_buffers

U8 = np.uint64
TOP = U8(0xFFFFFFFF00000000)
#: Bytes of text that are hashed at a time; the arrays of so many stay in the processor's cache.
PIECE = 250_000


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first start, starts less one, anchor less first start, anchor hash) of every segment.

    Starts are relative to their document.
    """
    if len(data) < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    prefix = prefix_hash(data)
    value = mix((prefix[gram:] - prefix[:-gram]) * powers(INVERSE, len(prefix))[: len(prefix) - gram])
    low = value & TOP
    low |= np.arange(len(low), dtype=np.uint64)  # the leftmost of grams with equal upper halves stays, so the text alone decides
    span, width = 1, length - gram + 1  # grams of a string
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[step:], low[:-step])
        span += step
    anchor = low.astype(np.uint32)  # the lower half, its position
    new = np.ones(len(anchor), dtype=bool)
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    new[offsets[:-1][offsets[:-1] < len(new)]] = True
    first = np.flatnonzero(new)
    doc = np.searchsorted(offsets, first, side="right") - 1
    runs = np.minimum(np.append(first[1:], len(new)), offsets[doc + 1] - length + 1) - first - 1
    has = runs >= 0  # else it runs over the document's end
    doc, first, runs = doc[has], first[has], runs[has]
    at = anchor[first].astype(np.int64)
    return doc, first - offsets[doc], runs, at - first, value[at]


class Suffixes:
    """Suffixes of packed segments, sorted by their first ``length`` bytes, a few bytes a round."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = np.append(data, np.zeros(8, dtype=np.uint8)), length
        self.words = np.ndarray((len(data) + 1,), ">u8", self.data, strides=(1,))  # the eight bytes from every position on

    def classes(self, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order that sorts ``start`` within each group, class of each place in it): one class is one group's equal strings.

        A round sorts what is still tied by its class and its next bytes, as many as fit beside the class into 64 bits.
        """
        n = len(start)
        order = np.argsort(group)
        new = np.append(True, group[order[1:]] != group[order[:-1]]) if n else np.zeros(0, dtype=bool)
        width = (64 - n.bit_length()) // 8
        for at in range(0, self.length, width):
            tied = ~new
            tied[:-1] |= tied[1:]
            live = np.flatnonzero(tied)  # places whose class has others
            if not len(live):
                break
            rows, bits = order[live], 8 * min(width, self.length - at)
            key = self.words[start[rows] + at].astype(np.uint64) >> U8(64 - bits)
            key |= np.cumsum(new[live]).astype(np.uint64) << U8(bits)
            by = np.argsort(key)
            order[live], key = rows[by], key[by]
            new[live[1:]] |= key[1:] != key[:-1]
        return order, np.cumsum(new) - 1

    def sort(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order that sorts ``start`` within each group."""
        return self.classes(start, group)[0]


def string_minima(data: np.ndarray, seg_start: np.ndarray, seg_runs: np.ndarray, anchor_at: np.ndarray, key: np.ndarray, smallest: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of each distinct segment the smallest id that has it: (values, offsets by segment)."""
    count = seg_runs + 1
    offsets = np.concatenate([[0], np.cumsum(count)])
    seg = np.repeat(np.arange(len(count)), count)
    shift = np.arange(offsets[-1]) - offsets[seg]
    out = smallest[seg].copy()
    _, place = np.unique(key, return_inverse=True)
    mixed = np.bincount(place)[place][seg] > 1
    if not mixed.any():
        return out, offsets
    where = np.flatnonzero(mixed)
    group = place[seg[where]] * 64 + (anchor_at[seg[where]] - shift[where])
    start = seg_start[seg[where]] + shift[where]
    order, classes = Suffixes(data, length).classes(start, group)
    where = where[order]
    low = np.minimum.reduceat(out[where], np.flatnonzero(np.append(True, classes[1:] != classes[:-1])))
    out[where] = low[classes]
    return out, offsets


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary cells that lie one after another in ``data``; ``ends`` has 0 and each cell's end, in items."""
    item = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.asarray(ends * item.itemsize, dtype=np.int64)), pa.py_buffer(item)]).cast(pa.binary())


def _cells(value: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """(every value once, for each column one binary cell a value with its items, in their order)."""
    order = _order(value)
    value = value[order]
    ends = np.append(np.flatnonzero(np.append(True, value[1:] != value[:-1])), len(value)) if len(value) else np.zeros(1, dtype=np.int64)
    return value[ends[:-1]].astype(np.int64), [_binary(c[order], ends) for c in columns]


def _order(value: np.ndarray) -> np.ndarray:
    """Stable order of values that are not negative; small ones are sorted by their digits."""
    return np.argsort(value.astype(np.uint16) if len(value) and value.max() < 1 << 16 else value, kind="stable")


def _column(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=dtype), *[np.frombuffer(v, dtype=dtype) for v in table.column(name).to_pylist() if v is not None]])


def _split(value: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(value, its rows in order) of every value."""
    order = np.argsort(value, kind="stable")
    cuts = np.flatnonzero(np.diff(value[order])) + 1
    return [(int(value[rows[0]]), rows) for rows in np.split(order, cuts) if len(rows)]


def distinct_segments(data: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, ext: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each distinct segment, which distinct one each segment is): equal by hash, then byte by byte."""
    mark = key ^ ext.astype(np.uint64)
    for at in range(0, len(start), 10_000):  # segments lie one after another, so a stretch of them is hashed by itself
        rows = slice(at, at + 10_000)
        a, b = start[rows] - start[at], start[rows] - start[at] + size[rows]
        prefix = prefix_hash(data[start[at] : start[at] + b[-1]])
        mark[rows] ^= mix((prefix[b] - prefix[a]) * powers(INVERSE, len(prefix))[a] + ext[rows].astype(np.uint64))
    _, one, seg = np.unique(mark, return_index=True, return_inverse=True)
    other = start[one][seg]
    odd = (size != size[one][seg]) | (key != key[one][seg]) | (ext != ext[one][seg])
    shared = np.flatnonzero((other != start) & ~odd)
    for at in range(0, len(shared), 50_000):
        rows = shared[at : at + 50_000]
        n = size[rows]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differs = data[np.repeat(start[rows], n) + step] != data[np.repeat(other[rows], n) + step]
        odd[rows[np.add.reduceat(differs, np.cumsum(n) - n) > 0]] = True
    extra = np.flatnonzero(odd)
    seg = seg.copy()
    seg[extra] = len(one) + np.arange(len(extra))
    return np.append(one, extra), seg


def all_string_minima(data: np.ndarray, start: np.ndarray, size: np.ndarray, ext: np.ndarray, key: np.ndarray, smallest: np.ndarray, length: int, most: int = 1_500_000) -> tuple[np.ndarray, np.ndarray]:
    """``string_minima`` of any number of segments, those of a few anchors at a time: about ``most`` bytes."""
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order[1:]] != key[order[:-1]]) if len(key) else np.zeros(0, dtype=bool)
    stretch = (np.cumsum(size[order]) // most)[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]  # an anchor goes with its first segment
    count = ext // 64 + 1
    offsets = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(offsets[-1], dtype=np.int64)
    for _, at in _split(stretch):
        rows = order[at]
        n = size[rows]
        own = np.cumsum(n) - n
        values, _ = string_minima(data[np.repeat(start[rows] - own, n) + np.arange(n.sum())], own, ext[rows] // 64, ext[rows] % 64, key[rows], smallest[rows], length)
        c = count[rows]
        out[np.repeat(offsets[rows] - np.cumsum(c) + c, c) + np.arange(c.sum())] = values
    return out, offsets


def constant_runs(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, last + 1, value) of the maximal runs of one value inside each segment."""
    seg = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    new = np.ones(len(values) + 1, dtype=bool)
    new[1:-1] = (values[1:] != values[:-1]) | (seg[1:] != seg[:-1])
    at = np.flatnonzero(new)
    head, tail = at[:-1], at[1:]
    return seg[head], head - offsets[seg[head]], tail - offsets[seg[head]], values[head]


class Group:
    """The documents of one group in the order of (id, hash of the text), equal rows once."""

    def __init__(self, table: pa.Table):
        ids, marks = table.column("doc_id").to_numpy(), table.column("mark").to_numpy()
        order = np.lexsort((marks, ids))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (ids[order[1:]] != ids[order[:-1]]) | (marks[order[1:]] != marks[order[:-1]])
        self.row = order[new]
        self.ids = ids[self.row]
        self.place = np.zeros(len(order), dtype=np.int64)
        self.place[order] = np.cumsum(new) - 1
        text = table.column("text").cast(pa.large_string()).combine_chunks()
        self.texts = pa.table({"text": text.take(pa.array(self.row))})

    def parts(self):
        """(first row, bytes, offsets) of stretches of about ``PIECE`` bytes."""
        at = 0
        for batch in self.texts.to_batches():
            for piece in pieces(iter([batch]), most=PIECE):
                data, offsets = string_buffers(piece.column("text"))
                yield at, data, offsets
                at += piece.num_rows


def _own(docs: DataFrame, n_groups: int) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return own.withColumn("mark", F.xxhash64("text")).withColumn("g", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(n_groups)))


SEGMENTS = {"bucket": pa.int64(), "g": pa.int64(), **dict.fromkeys(("key", "ext", "bytes", "low", "seg", "row", "first"), pa.binary())}
SCHEMA = pa.schema(SEGMENTS)


def occurrences(docs: DataFrame, length: int, gram: int, n_groups: int, n_buckets: int) -> DataFrame:
    """Per group the segments that others may have, too: rows with a bucket hold distinct segments, rows without one where they occur."""
    own = _own(docs, n_groups).where("doc_id is not null")

    def deal(batches):
        """Each group's anchors once, packed by bucket; the lowest bit says whether several of its documents have it."""
        parts, held = [], 0
        for piece in pieces(batches, most=PIECE):
            data, offsets = string_buffers(piece.column("text"))
            doc, _, _, _, key = anchors(data, offsets, length, gram)
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            parts.append((key[new], piece.column("g").to_numpy()[doc[new]], (np.int64(held) << 32) + doc[new]))
            held += int(new.sum())
            if held > 1_000_000:
                yield packed(parts)
                parts, held = [], 0
        if held:
            yield packed(parts)

    def packed(parts):
        key, group, doc = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(key ^ mix(group.astype(np.uint64)))  # equal pairs of anchor and group come together; should others come between, one is named twice
        key, group, doc = key[order], group[order], doc[order]
        head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
        several = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
        key, mark = key[head], (group[head] * 2 + several).astype(np.uint32)
        bucket, cells = _cells((key >> U8(32)).astype(np.int64) % n_buckets, key, mark)
        return pa.RecordBatch.from_arrays([pa.array(bucket), *cells], names=["bucket", "key", "grp"])

    def repeated(table: pa.Table) -> pa.Table:
        """The anchors of each group that more than one document has."""
        key, mark = _column(table, "key", "u8"), _column(table, "grp", "u4")
        order = np.argsort(key, kind="stable")
        key, mark = key[order], mark[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=int)
        size = np.diff(np.append(head, len(key)))
        several = (size > 1) | (np.maximum.reduceat(mark & 1, head) > 0) if len(head) else np.zeros(0, dtype=bool)
        keep = np.repeat(several, size)
        key, group = key[keep], (mark[keep] >> 1).astype(np.int64)
        order = _order(group)
        key, group = key[order], group[order]
        new = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))[: len(key)]
        groups, cells = _cells(group[new], key[new])
        return pa.table([pa.array(groups), *cells], names=["g", "key"])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        wanted = np.unique(_column(right, "key", "u8"))
        if left.num_rows and len(wanted):
            group, g = Group(left), int(left.column("g")[0].as_py())
            found = [[] for _ in range(5)]  # row, first, ext, key, bytes
            for at, data, offsets in group.parts():
                doc, first, runs, to, key = anchors(data, offsets, length, gram)
                hit = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                doc, first, runs, to, key = doc[hit], first[hit], runs[hit], to[hit], key[hit]
                size = runs + length
                take = np.repeat(offsets[doc] + first - np.cumsum(size) + size, size) + np.arange(size.sum())
                for have, x in zip(found, (doc + at, first, runs * 64 + to, key, data[take]), strict=True):
                    have.append(x)
            row, first, ext, key, data = (np.concatenate(x) for x in found)
            size = ext // 64 + length
            start = np.cumsum(size) - size
            one, seg = distinct_segments(data, start, size, key, ext)
            low = np.full(len(one), np.iinfo(np.int64).max)
            np.minimum.at(low, seg, group.ids[row])
            segs = _order(bucket := (key[one] >> U8(32)).astype(np.int64) % n_buckets)
            i = one[segs]
            ends = np.cumsum(size[i])
            take = np.repeat(start[i] - ends + size[i], size[i]) + np.arange(size[i].sum())
            buckets, cells = _cells(bucket[segs], key[i], ext[i].astype(np.uint16), low[segs], segs.astype(np.uint32))
            last = np.searchsorted(bucket[segs], buckets, side="right")
            cells.append(_binary(data[take], np.append(0, ends[last - 1])))
            out.append(dict(zip(("key", "ext", "low", "seg", "bytes"), cells, strict=True)) | {"bucket": pa.array(buckets), "g": pa.array(np.full(len(buckets), g))})
            out.append({"g": pa.array([g])} | {n: _binary(x.astype(np.uint32), np.array([0, len(x)])) for n, x in (("seg", seg), ("row", row), ("first", first))})
        return pa.concat_tables([pa.table({c: rows[c] if c in rows else pa.nulls(len(rows["g"]), t) for c, t in SEGMENTS.items()}) for rows in out] or [SCHEMA.empty_table()])

    dealt = own.repartition("g").mapInArrow(deal, "bucket long, key binary, grp binary")
    again = materialise(dealt.groupBy("bucket").applyInArrow(lambda t: repeated(t), "g long, key binary"), "anchors")
    found = own.groupBy("g").cogroup(again.groupBy("g")).applyInArrow(cut, "bucket long, g long, key binary, ext binary, bytes binary, low binary, seg binary, row binary, first binary")
    found = materialise(found, "segments")
    drop(again)
    return found


def smallest_ids(segments: DataFrame, length: int) -> DataFrame:
    """(g, seg, a, b, low): the starts a to b - 1 of the group's segment seg are strings whose smallest id is low."""

    def decide(table: pa.Table) -> pa.Table:
        key, ext, data = _column(table, "key", "u8"), _column(table, "ext", "u2").astype(np.int64), _column(table, "bytes", "u1")
        low, seg = _column(table, "low", "i8"), _column(table, "seg", "u4")
        group = np.repeat(table.column("g").to_numpy(), [len(v) // 8 for v in table.column("key").to_pylist()])
        size = ext // 64 + length
        start = np.cumsum(size) - size
        one, same = distinct_segments(data, start, size, key, ext)
        smallest = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(smallest, same, low)
        values, offsets = all_string_minima(data, start[one], size[one], ext[one], key[one], smallest, length)
        owner, a, b, value = constant_runs(values, offsets)
        count = np.bincount(owner, minlength=len(one))
        begin = np.cumsum(count) - count
        own = count[same]
        take = np.repeat(begin[same] - np.cumsum(own) + own, own) + np.arange(own.sum())
        group, seg = np.repeat(group, own), np.repeat(seg, own)
        groups, cells = _cells(group, seg, a[take].astype(np.uint8), b[take].astype(np.uint8), value[take])
        return pa.table([pa.array(groups), *cells], names=["g", "seg", "a", "b", "low"])

    return segments.groupBy("bucket").applyInArrow(lambda t: decide(t), "g long, seg binary, a binary, b binary, low binary")


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    head = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return start[head], reach[np.append(head[1:] - 1, len(start) - 1)]


def removed_spans(group: Group, found: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the removed spans of a group, not merged, from its occurrences and the smallest ids of their strings."""
    seg, row, first = (_column(found, c, "u4").astype(np.int64) for c in ("seg", "row", "first"))
    own, a, b, low = _column(found, "of", "u4").astype(np.int64), _column(found, "a", "u1").astype(np.int64), _column(found, "b", "u1").astype(np.int64), _column(found, "low", "i8")
    order = np.argsort(own, kind="stable")
    own, a, b, low = own[order], a[order], b[order], low[order]
    begin, end = np.searchsorted(own, seg), np.searchsorted(own, seg, side="right")
    out = [[np.zeros(0, dtype=np.int64)] for _ in range(3)]
    for at in range(0, len(seg), 500_000):
        s, n = begin[at : at + 500_000], (end - begin)[at : at + 500_000]
        which = np.repeat(np.arange(len(s)), n)
        run = np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())
        r, f = row[at : at + 500_000][which], first[at : at + 500_000][which]
        gone = low[run] < group.ids[r]
        for have, x in zip(out, (r[gone], (f + a[run])[gone], (f + b[run] - 1 + length)[gone]), strict=True):
            have.append(x)
    row, start, end = (np.concatenate(x) for x in out)
    return row, start, end


def suffix_dedup(docs: DataFrame, length: int = 50, gram: int = 20, group_bytes: int = 4_000_000, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes) on request.

    Documents are dealt into groups of about ``group_bytes`` bytes of text, anchors into buckets for twice as many.
    """
    total = docs.select(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    n_groups, n_buckets = max(scaled_partitions(docs.sparkSession), -(-total // group_bytes)), max(8, -(-total // (2 * group_bytes)))
    found = occurrences(docs, length, gram, n_groups, n_buckets)
    lows = materialise(smallest_ids(found.where("bucket is not null"), length), "smallest")
    blank = F.lit(None).cast("binary")
    occurring = found.where("bucket is null").select("g", "seg", "row", "first", blank.alias("of"), blank.alias("a"), blank.alias("b"), blank.alias("low"))
    back = occurring.unionByName(lows.select("g", blank.alias("seg"), blank.alias("row"), blank.alias("first"), F.col("seg").alias("of"), "a", "b", "low"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            group = Group(left)
            row, start, end = removed_spans(group, right, length)
            order = np.argsort(row, kind="stable")
            row, start, end = row[order], start[order], end[order]
            cuts = np.searchsorted(row, np.arange(len(group.ids) + 1))
            for at, data, offsets in group.parts():
                for i in range(len(offsets) - 1):
                    text, c = data[offsets[i] : offsets[i + 1]], slice(cuts[at + i], cuts[at + i + 1])
                    a, b = merged(start[c], end[c])
                    kept = b"".join(text[x:y].tobytes() for x, y in zip(np.append(0, b), np.append(a, len(text)), strict=True))
                    rows.append((len(text), len(text) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            rows = [rows[i] for i in group.place]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        arrays = [left.column("doc_id").combine_chunks() if left.num_rows else pa.array([], pa.int64()), *[pa.array(columns[j], pa.int64()) for j in range(3)], pa.array(columns[3], pa.string())]
        return pa.table(arrays + [pa.array(columns[4], pa.binary())] * keep_text, names=names)

    # A document without an id is in no group's occurrences; as the least id it would cost others bytes, so it is left out above.
    own = _own(docs, n_groups)
    return own.where("doc_id is not null").groupBy("g").cogroup(back.groupBy("g")).applyInArrow(finish, schema).unionByName(_without_id(own.where("doc_id is null"), keep_text))


def _without_id(rows: DataFrame, keep_text: bool) -> DataFrame:
    text = F.encode("text", "UTF-8")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), *[text.alias("kept")] * keep_text)
