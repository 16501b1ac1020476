"""Importance resampling towards a target: a dictionary of distinct features, gains by hashed bucket, Gumbel top-k.

Texts are cut into words and their runs in tasks, a block of documents at a time: the block's distinct features with their
totals, a few thousand a row, and one row a document with its counts as positions in that list. So a feature that every
document has is once a block in what is shuffled afterwards, not once a document, and no row is larger than a document.
Features are counted as strings over all blocks, each distinct string is hashed once, and buckets are added up from the
dictionary. A bucket's gain compares its share of the target with that of the corpus. Gains go back to the blocks by the
feature string, and from there to the documents by position; a task holds one block's gains and documents at a time.

The draw is Gumbel top-k: weight plus noise that is a hash of the document's id. Ranks are a range-partitioned sort with a
count per partition, so no task sees all rows.

Defined cases: null and empty texts hold no feature and have weight 0; texts of fewer words than ``least_words`` are scored
but never drawn; ties go to the smaller id; repeated rows are scored alike and ranked one after the other; a document without
an id has the noise of an empty id and comes last among ties; an empty target gives gains by the corpus alone; an empty table
gives no rows; extra columns, whatever their names, are ignored. A text of any length is one document of one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finsheet.llm.common import drop, hot_join, materialise
from finsheet.llm.kernel import mix, pieces, prefix_hash, span_hash, string_buffers

#: UTF-8 form of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased: digits, a-z and every byte of other letters stay, the rest is a space.
LETTER = np.full(256, ord(" "), dtype=np.uint8)
for _r in (range(48, 58), range(97, 123), range(128, 256)):
    LETTER[list(_r)] = _r
LETTER[65:91] = LETTER[97:123]
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Most features in a row.
ROW_WORDS = 4096
#: A row has either features, from position ``first`` of the block's list on, or a document.
BLOCK = "block long, first int, words array<binary>, totals array<long>, doc_id long, n_words long, at array<int>, times array<int>"


def runs_of_words(data: np.ndarray, offsets: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, document of all runs of 1 to ``longest`` words in it, words by document): words of longer runs are joined by one space."""
    low = np.append(LETTER[data], np.uint8(ord(" ")))
    inside = low != ord(" ")
    head, tail = inside.copy(), inside[:-1] & ~inside[1:]
    head[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]  # a text ends its last word
    head[cuts] = inside[cuts]
    tail[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    n_words = np.bincount(doc, minlength=len(offsets) - 1)
    if longest == 1:
        return low, start, end, doc, n_words
    room = end - start + 1
    place = np.cumsum(room) - room
    text = low[np.repeat(start - place, room) + np.arange(room.sum())]
    text[place + room - 1] = ord(" ")
    found = [(place, place + room - 1, doc)]
    for n in range(2, longest + 1):
        i = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
        found.append((place[i], (place + room - 1)[i + n - 1], doc[i]))
    return text, *(np.concatenate(x) for x in zip(*found, strict=True)), n_words


def distinct(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one span of each string, which string each span is): equal by hash, then byte by byte; of a shared hash each other span is its own string."""
    size = end - start
    key = size.astype(np.uint64)
    for at in range(0, len(start), 50_000):  # spans lie one after another, so a stretch of them is hashed by itself
        a, b = start[at : at + 50_000], end[at : at + 50_000]
        key[at : at + 50_000] += span_hash(prefix_hash(text[a.min() : b.max()]), a - a.min(), b - a.min())
    _, one, which = np.unique(mix(key), return_index=True, return_inverse=True)
    first = one[which]
    odd = size != size[first]
    for at in range(0, len(start), 50_000):
        rows = at + np.flatnonzero(~odd[at : at + 50_000])
        ends = np.cumsum(size[rows])
        step = np.arange(size[rows].sum()) - np.repeat(ends - size[rows], size[rows])
        differs = np.flatnonzero(text[np.repeat(start[rows], size[rows]) + step] != text[np.repeat(start[first[rows]], size[rows]) + step])
        odd[rows[np.searchsorted(ends, differs, side="right")]] = True
    extra = np.flatnonzero(odd)
    which = which.copy()
    which[extra] = len(one) + np.arange(len(extra))
    return np.append(one, extra), which


def block_rows(block: int, ids: pa.Array, texts: pa.Array, longest: int):
    """Two batches of rows of BLOCK: of features, the most frequent first, and of documents."""
    data, offsets = string_buffers(texts)
    text, start, end, doc, n_words = runs_of_words(data, offsets, longest)
    one, which = distinct(text, start, end)
    totals = np.bincount(which, minlength=len(one))
    by = np.argsort(-totals, kind="stable")
    rank = np.empty(len(one), dtype=np.int64)
    rank[by] = np.arange(len(one))
    one, totals = one[by], totals[by]
    pairs = np.sort(doc * max(1, len(one)) + rank[which])
    heads = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, dtype=np.int64)
    owner, at = np.divmod(pairs[heads], max(1, len(one)))
    size = (end - start)[one]
    ends = np.cumsum(size)
    letters = text[np.repeat(start[one] - ends + size, size) + np.arange(size.sum())]
    words = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(letters)])
    first = np.arange(0, len(one), ROW_WORDS)
    listed = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    of_doc = np.searchsorted(owner, np.arange(len(ids) + 1))
    rows = (
        {"first": pa.array(first, pa.int32()), "words": listed(np.append(first, len(one)), words), "totals": listed(np.append(first, len(one)), pa.array(totals, pa.int64()))},
        {"doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "at": listed(of_doc, pa.array(at, pa.int32())), "times": listed(of_doc, pa.array(np.diff(np.append(heads, len(pairs))), pa.int32()))},
    )
    kinds = {"block": pa.int64(), "first": pa.int32(), "words": pa.list_(pa.binary()), "totals": pa.list_(pa.int64()), "doc_id": pa.int64(), "n_words": pa.int64(), "at": pa.list_(pa.int32()), "times": pa.list_(pa.int32())}
    for columns, n in zip(rows, (len(first), len(ids)), strict=True):
        own = columns | {"block": pa.array(np.full(n, block))}
        yield pa.RecordBatch.from_arrays([own[c] if c in own else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))


def blocks(docs: DataFrame, id_column: str, longest: int) -> DataFrame:
    """Per block of documents rows of its distinct features with totals, and one row a document with positions and counts."""

    def cut(batches):
        from pyspark import TaskContext

        block, parts, held = TaskContext.get().partitionId() << 32, [], 0

        def rows():
            return block_rows(block, *(pa.concat_arrays([p.column(c) for p in parts]) for c in ("doc_id", "text")), longest)

        for piece in pieces(batches, most=BLOCK_BYTES):
            size = (pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0) + 64 * piece.num_rows
            if parts and held + size > BLOCK_BYTES:
                yield from rows()
                block, parts, held = block + 1, [], 0
            parts.append(piece)
            held += size
        if parts:
            yield from rows()

    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col("text")).mapInArrow(cut, BLOCK)


def dictionary(packed: DataFrame, buckets: int) -> DataFrame:
    """(word, n, blocks, bucket): every distinct feature once, with its count, the blocks that hold it and its bucket."""
    each = packed.select(F.explode(F.arrays_zip("words", "totals")).alias("f")).select(F.col("f.words").alias("word"), F.col("f.totals").alias("n"))
    counted = each.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"))
    return counted.withColumn("bucket", (F.crc32("word") % buckets).cast("int"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of all ``buckets`` buckets, from the dictionaries of corpus and target."""
    s = corpus.groupBy("bucket").agg(F.sum("n").alias("s"))
    t = target.groupBy("bucket").agg(F.sum("n").alias("t"))
    total = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n, target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n  # two numbers
    of = lambda c: F.coalesce(c, F.lit(0)).cast("double") + 1
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left")
    ratio = of("t") * F.lit(float(total[0] + buckets)) / (of("s") * F.lit(float(total[1] + buckets)))
    return every.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weights(packed: DataFrame, words: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight) from blocks, the dictionary and the gains of buckets."""
    known = materialise(words.join(F.broadcast(table), "bucket").select("word", "gain", "blocks"), "gains")  # as many rows as buckets
    held = packed.select("block", "first", F.posexplode("words").alias("i", "word")).select("block", (F.col("first") + F.col("i")).alias("i"), "word")
    total = packed.where("words is not null").agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    of_block = materialise(hot_join(held, known, "word", "blocks", total).select("block", "i", F.col("gain").cast("int").alias("gain")), "block_gains")
    drop(known)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        gain = np.zeros(right.num_rows, dtype=np.int64)
        gain[right.column("i").to_numpy()] = right.column("gain").to_numpy()
        ends = np.append(0, np.cumsum(pc.list_value_length(left.column("at")).to_numpy()))
        at, times = (pc.list_flatten(left.column(c)).to_numpy() for c in ("at", "times"))
        added = lambda v: pa.array(np.diff(np.append(0, np.cumsum(v, dtype=np.int64))[ends]), pa.int64())
        return pa.table([left.column("doc_id"), left.column("n_words"), added(times), added(gain[at] * times)], names=["doc_id", "n_words", "n_features", "weight"])

    documents = packed.where("words is null").select("block", "doc_id", "n_words", "at", "times")
    return documents.groupBy("block").cogroup(of_block.groupBy("block")).applyInArrow(lambda a, b: score(a, b), "doc_id long, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """``scored`` with rank: 1 to ``drawn`` for the highest scores of eligible rows, ties to the smaller id, else null."""
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = scored.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    part, i = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialise(placed.withColumn("part", part).withColumn("i", i).drop("at"), "placed")
    sizes = placed.where("eligible").groupBy("part").count()  # one row a partition
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    rank = F.coalesce("before", F.lit(0)) + F.col("i") + 1
    return placed.join(F.broadcast(before), "part", "left").withColumn("rank", F.when(F.col("eligible") & (rank <= drawn), rank)).drop("part", "i", "before")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, id_column: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (null: not drawn), n_words.

    ``longest`` is the longest run of words that is a feature; ``percent`` of the documents of ``least_words`` words or more
    are drawn.
    """
    packed = materialise(blocks(docs, id_column, longest), "blocks")
    of_target = blocks(target.select(F.lit(0).alias("doc_id"), F.col("text")), "doc_id", longest)
    words = materialise(dictionary(packed, buckets), "dictionary")
    table = gains(words, dictionary(of_target, buckets), buckets)
    own = weights(packed, words, table)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((noise + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = materialise(own.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel).alias("score"), "n_words", (F.col("n_words") >= least_words).alias("eligible")), "scored")
    drop(packed, words)
    drawn = scored.where("eligible").count() * percent // 100
    return ranked(scored, drawn).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
