"""Token counts of documents in flat, unindexed token files.

A flat file is a run of unsigned integers with an end-of-document id after each document and nothing else: no
index says where a document starts. The scan treats a file as byte ranges of any size, which tasks read by themselves,
searches each range for the id with one vector comparison, and stitches documents that cross ranges by a prefix scan in
two levels: over the ranges of a stretch of STRETCH ranges, and over the stretches of a file. No task sees a whole file.

Files are reached through ``pyarrow.fs``, by the address of the shared folder. A writing task writes under a name of its own
and moves the file when it is whole, so a task that runs again leaves the same file.

Defined cases: a null or empty text has 0 tokens; a text of any length is written and counted whole; tokens after a file's
last separator are one more document with ``closed`` false; an empty file or a null range counts nothing; ids or ranges that
do not fit the width raise; repeated documents are counted each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finsheet.llm.common import materialise, scaled_partitions, shared_dir

#: Fixed value: the public splitting pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DTYPES = {2: np.dtype("<u2"), 4: np.dtype("<u4")}
#: Ranges of a stretch of the prefix scan.
STRETCH = 256


def _opened(address: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address as Spark writes it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", address))


def read_blocks(spark: SparkSession, path: str, block_bytes: int = 1 << 20) -> DataFrame:
    """(shard, block, start, size): the flat files under ``path`` as ranges of bytes. Only their lengths are looked up here."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("shard"), "length").where("length > 0")
    ranges = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / block_bytes) - 1)))
    start = F.col("block") * block_bytes
    return ranges.select("shard", "block", start.alias("start"), F.least(F.lit(block_bytes).cast("long"), F.col("length") - start).alias("size"))


def write_flat(docs: DataFrame, encoder, eod: int, width: int = 2) -> tuple[str, DataFrame]:
    """(folder, order): each partition of ``docs`` becomes one flat file of a new folder in the shared place.

    ``order`` says which documents a file holds, in order: (shard, first, doc_ids), shard being the file's name.
    ``encoder()`` gives a function from a text to its token ids; it is called once per task.
    """
    dtype, most = DTYPES[width], int(np.iinfo(DTYPES[width]).max)
    folder = f"{shared_dir(docs.sparkSession)}/flat-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, order, out, name, own = encoder(), 0, None, "", ""
        system, place = _opened(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                if out is None:
                    name = f"shard-{part.column('part')[0].as_py():06d}.bin"
                    own = f"{place}/_writing-{name}-{uuid.uuid4().hex}"
                    system.create_dir(place, recursive=True)
                    out = system.open_output_stream(own)
                for text in part.column("text"):
                    ids = np.append(encode(text.as_py() or ""), eod)
                    if ids.max() > most:
                        raise ValueError(f"token id {ids.max()} does not fit into {width} bytes")
                    out.write(ids.astype(dtype).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([order], pa.int64()), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64()))], names=["shard", "first", "doc_ids"])
                order += part.num_rows
        if out is not None:
            out.close()
            system.move(own, f"{place}/{name}")

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part"))
    return folder, materialise(own.mapInArrow(write, "shard string, first long, doc_ids array<long>"), "order")


def summaries(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """(shard, block, ends, head, tail, inner) of every range: its separators, the tokens before the first and after the last
    one (all tokens where there is none), and those between them.

    ``blocks`` has either the ranges of files (start, size), whose bytes each task reads for itself, or the bytes (data).
    """
    dtype, given = DTYPES[width], "data" in blocks.columns

    def ranges(batch: pa.RecordBatch) -> Iterator[bytes]:
        if given:
            yield from (raw or b"" for raw in batch.column("data").to_pylist())
            return
        for shard, start, size in zip(*[batch.column(c).to_pylist() for c in ("shard", "start", "size")], strict=True):
            system, path = _opened(shard)
            with system.open_input_file(path) as f:
                yield f.read_at(size, start)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(ranges(batch)):
                if len(raw) % width:
                    raise ValueError(f"a range of {len(raw)} bytes cuts a token of {width} bytes")
                ids = np.frombuffer(raw, dtype=dtype)
                at = np.flatnonzero(ids == eod)
                head, tail = (int(at[0]), len(ids) - int(at[-1]) - 1) if len(at) else (len(ids), len(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("shard").slice(i, 1), batch.column("block").slice(i, 1), *[pa.array([v], pa.int64()) for v in (len(at), head, tail)], pa.array([(np.diff(at) - 1).tolist()], pa.list_(pa.int64()))],
                    names=["shard", "block", "ends", "head", "tail", "inner"],
                )

    own = blocks.select("shard", F.col("block").cast("long").alias("block"), *(["data"] if given else ["start", "size"]))
    if not given:
        own = own.repartition(scaled_partitions(blocks.sparkSession, 2), "shard", "block")
    return own.mapInArrow(summarise, f"shard {dict(own.dtypes)['shard']}, block long, ends long, head long, tail long, inner array<long>")


def _stitched(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds, for each row, first (separators before it), carried (tokens since the last of them, or since the start) and
    after_end (whether there is one)."""
    w = Window.partitionBy(*by).orderBy(order)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__run", F.sum(F.when(F.col("ends") == 0, F.col("tail")).otherwise(0)).over(upto))
    mark = F.when(F.col("ends") > 0, F.struct(F.col("tail"), F.col("__run").alias("run")))
    rows = rows.withColumns({"first": F.coalesce(F.sum("ends").over(before), F.lit(0)), "__mark": F.last(mark, ignorenulls=True).over(before), "__gone": F.coalesce(F.lag("__run").over(w), F.lit(0))})
    carried = F.coalesce(F.col("__mark.tail"), F.lit(0)) + F.col("__gone") - F.coalesce(F.col("__mark.run"), F.lit(0))
    return rows.withColumns({"carried": carried, "after_end": F.col("__mark").isNotNull()}).drop("__run", "__mark", "__gone")


def _left_open(carried: Column) -> Column:
    """Tokens between the last separator and the end of a row."""
    return F.when(F.col("ends") > 0, F.col("tail")).otherwise(carried + F.col("tail"))


def scan(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """Per document of each file: shard, ordinal (from 0), n_tokens without its separator, closed."""
    seen = materialise(summaries(blocks, eod, width), "summaries").withColumn("stretch", F.floor(F.col("block") / STRETCH))
    inside = _stitched(seen, ["shard", "stretch"], "block")
    whole = inside.withColumn("open", _left_open(F.col("carried"))).groupBy("shard", "stretch").agg(F.sum("ends").alias("ends"), F.max_by("open", "block").alias("tail"), F.max("block").alias("last"))
    over = _stitched(whole, ["shard"], "stretch").withColumn("final", F.lead("stretch").over(Window.partitionBy("shard").orderBy("stretch")).isNull())
    over = over.select("shard", "stretch", F.col("first").alias("first_of"), F.col("carried").alias("carried_in"), F.when(F.col("final"), F.col("last")).alias("last"))
    carried = F.col("carried") + F.when(F.col("after_end"), 0).otherwise(F.col("carried_in"))
    rows = inside.join(over, ["shard", "stretch"]).withColumns({"first": F.col("first") + F.col("first_of"), "carried": carried, "at_end": F.coalesce(F.col("block") == F.col("last"), F.lit(False))})
    closed = F.when(F.col("ends") > 0, F.concat(F.array(F.col("carried") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    left = _left_open(F.col("carried"))
    counts = F.when(F.col("at_end") & (left > 0), F.concat(closed, F.array(left))).otherwise(closed)
    return rows.select("shard", "first", "ends", F.posexplode(counts).alias("i", "n_tokens")).select("shard", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens", (F.col("i") < F.col("ends")).alias("closed"))


@lru_cache(maxsize=2)
def _encoding(path: str):
    """The vocabulary at ``path``, loaded once in a worker however many tasks it runs."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def rank_encoder(path: str):
    """Encoder factory for a byte-level BPE vocabulary of ``token rank`` lines; ``path`` is read by each worker."""

    def make():
        encoding = _encoding(path)
        return lambda text: encoding.encode_to_numpy(text, disallowed_special=())

    return make
