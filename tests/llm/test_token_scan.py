"""Separator scan: exact round trip over blocks of any size."""

from __future__ import annotations

import numpy as np
import pytest

from finsheet.llm.llm_queries import END_OF_DOCUMENT, VOCABULARY, op6_token_counts
from finsheet.llm.token_scan import rank_encoder, read_blocks, scan, write_flat

EOD = 9


def blocks(spark, files, size, width=2):
    rows = []
    for shard, ids in enumerate(files):
        raw = np.array(ids, dtype="<u2" if width == 2 else "<u4").tobytes()
        rows += [(shard, n, bytearray(raw[at : at + size * width]), "x") for n, at in enumerate(range(0, max(1, len(raw)), size * width))]
    return spark.createDataFrame(rows, "shard int, block long, data binary, ends string").repartition(3)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_any_block_size(spark, size):
    rng = np.random.default_rng(size)
    files = [[int(x) for x in rng.integers(0, 10, n)] for n in (0, 1, 40, 300)] + [[EOD] * 5, [1] * 50, [1] * 20 + [EOD]]
    want = []
    for shard, ids in enumerate(files):
        run, ordinal = 0, 0
        for x in ids:
            if x == EOD:
                want.append((shard, ordinal, run, True))
                run, ordinal = 0, ordinal + 1
            else:
                run += 1
        if run:
            want.append((shard, ordinal, run, False))
    got = sorted((r.shard, r.ordinal, r.n_tokens, r.closed) for r in scan(blocks(spark, files, size), EOD).collect())
    assert got == want


def test_wide_ids_and_empty_blocks(spark):
    got = scan(blocks(spark, [[70_000, EOD, 5]], 2, 4).unionByName(spark.createDataFrame([(0, 99, None, "")], "shard int, block long, data binary, ends string")), EOD, 4).collect()
    assert sorted((r.ordinal, r.n_tokens) for r in got) == [(0, 1), (1, 1)]


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], "shard int, block long, data binary"), EOD).count() == 0


def test_files_are_read_as_blocks(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([1, 2, EOD, 3, EOD], dtype="<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    got = scan(read_blocks(spark, str(tmp_path), 4), EOD).collect()
    assert sorted((r.ordinal, r.n_tokens) for r in got) == [(0, 2), (1, 1)]


def test_query_agrees_with_the_tokenizer(spark, sf):
    encode = rank_encoder(VOCABULARY)()
    want = {r.doc_id: len(encode(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: r.n_tokens for r in op6_token_counts(spark, sf).collect()} == want
    assert END_OF_DOCUMENT > max(int(x) for t in ("one two", "été") for x in encode(t))


def test_ranges_of_many_stretches(spark, tmp_path, monkeypatch):
    """A file of more ranges than a stretch holds, with documents over several stretches."""
    from finsheet.llm import token_scan

    monkeypatch.setattr(token_scan, "STRETCH", 3)
    rng = np.random.default_rng(5)
    sizes = [*rng.integers(0, 9, 40).tolist(), 90, 0, 0, 55, 3]
    ids = np.concatenate([np.append(rng.integers(0, EOD, n), EOD) for n in sizes] + [np.ones(7)])
    ids.astype("<u2").tofile(tmp_path / "a.bin")
    got = sorted((r.ordinal, r.n_tokens, r.closed) for r in scan(read_blocks(spark, str(tmp_path), 8), EOD).collect())
    assert got == [(i, n, True) for i, n in enumerate(sizes)] + [(len(sizes), 7, False)]


def test_ranges_that_cut_a_token_raise(spark, tmp_path):
    np.arange(10, dtype="<u2").tofile(tmp_path / "a.bin")
    with pytest.raises(Exception, match="cuts a token"):
        scan(read_blocks(spark, str(tmp_path), 5), EOD).collect()


def test_very_long_null_and_repeated_documents(spark):
    rows = [(1, "a b " * 50_000), (2, None), (2, ""), (3, "x"), (3, "x")]
    encode = rank_encoder(VOCABULARY)()
    folder, order = write_flat(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), rank_encoder(VOCABULARY), END_OF_DOCUMENT)
    counts = [r.n_tokens for r in scan(read_blocks(spark, folder, 4096), END_OF_DOCUMENT).collect()]
    assert sorted(counts) == sorted(len(encode(t or "")) for _, t in rows)
    assert sorted(i for r in order.collect() for i in r.doc_ids) == [1, 2, 2, 3, 3]
