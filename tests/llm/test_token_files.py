import base64

import numpy as np
import pytest
import tiktoken

from surecal.llm import token_files
from surecal.llm.common import table
from surecal.llm.queries import END_ID, QUERIES, RANKS, WORD_PATTERN


def documents(stream, end=9):
    """(start, n_tokens, closed) by reading one token after the other."""
    out, start = [], 0
    for i, t in enumerate(stream):
        if t == end:
            out.append((start, i - start, True))
            start = i + 1
    if start < len(stream):
        out.append((start, len(stream) - start, False))
    return out


STREAMS = [
    [], [9], [9, 9, 9], [1], [1, 2, 3, 4, 5, 6, 7, 8], [1, 9, 2, 2, 9], [1] * 30 + [9] + [2] * 41 + [9, 9, 3],
    list(np.random.default_rng(0).integers(0, 10, 5_000)), list(np.random.default_rng(1).integers(8, 10, 300)),
]


@pytest.mark.parametrize("block,chunk", [(1, 3), (4, 2), (7, 5), (100_000, 4_096)])
def test_raw_files(spark, tmp_path, monkeypatch, block, chunk):
    monkeypatch.setattr(token_files, "CHUNK_BLOCKS", chunk)
    for i, stream in enumerate(STREAMS):
        (tmp_path / f"f{i}.bin").write_bytes(np.array(stream, dtype="<u2").tobytes())
    got = {}
    for r in token_files.count_tokens(token_files.read_token_files(spark, str(tmp_path), block), 9).collect():
        got.setdefault(int(r.file.rsplit("f", 1)[1][:-4]), []).append((r.ordinal, r.start, r.n_tokens, r.closed))
    for i, stream in enumerate(STREAMS):
        assert sorted(got.get(i, [])) == [(k, *d) for k, d in enumerate(documents(stream))]


def test_documents_come_back(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, "some words é 漢字 " * (i % 9)) for i in range(200)] + [
        (300, None), (301, ""), (None, "no id"), (7, "twice"), (302, "long text, " * 30_000), (7, "twice"),
        (303, "<|endoftext|>")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, n_tokens string")
    stored = token_files.write_token_blocks(df, RANKS, WORD_PATTERN, END_ID, block_tokens=64)
    out = token_files.count_tokens(stored.where("kind = 'tokens'"), END_ID).join(
        token_files.document_order(stored), ["file", "ordinal"]).collect()
    want = sorted((i is None, i or 0, len(plain.encode_ordinary(t or ""))) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in out) == want
    assert all(r.closed for r in out)
    none = token_files.write_token_blocks(df.limit(0), RANKS, WORD_PATTERN, END_ID)
    assert token_files.count_tokens(none, END_ID).count() == 0


def test_query(spark, sf):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r.doc_id: r.n_tokens for r in QUERIES["op4_token_counts"](spark, sf).collect()}
    assert out == {r.doc_id: len(plain.encode_ordinary(r.text)) for r in table(spark, sf, "documents").collect()}


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    """A file beyond 2 GB (sparse), in ranges; its content is never one row."""
    with open(tmp_path / "f.bin", "wb") as raw:
        raw.truncate((2 << 30) + 6)
        raw.seek(2 << 30)
        raw.write(np.array([9, 4, 9], dtype="<u2").tobytes())
    blocks = token_files.read_token_files(spark, str(tmp_path), 1 << 22).where("no >= 250")
    rows = blocks.selectExpr("no", "length(data) AS n", "spark_partition_id() AS task", "right(hex(data), 12) AS tail").collect()
    assert sorted((r.no, r.n) for r in rows) == [(n, 1 << 23) for n in range(250, 256)] + [(256, 6)]
    assert len({r.task for r in rows}) > 1
    assert [r.tail for r in rows if r.no == 256] == ["090004000900"]


def test_files_written_hold_nothing_but_ids(spark, sf):
    docs = spark.createDataFrame([(1, "some words"), (None, None), (3, "")], "doc_id bigint, text string").repartition(2)
    folder, stored = token_files.write_token_files(docs, RANKS, WORD_PATTERN, END_ID)
    blocks = token_files.read_token_files(spark, folder, 2, stored.select("file").distinct())
    out = token_files.count_tokens(blocks, END_ID).selectExpr("substring_index(file, '/', -1) AS file", "ordinal", "n_tokens").join(
        token_files.document_order(stored), ["file", "ordinal"]).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, 0), (1, 2), (3, 0)]
    folder, stored = token_files.write_token_files(docs.limit(0), RANKS, WORD_PATTERN, END_ID)
    assert token_files.count_tokens(token_files.read_token_files(spark, folder, 2, stored.select("file").distinct()), END_ID).count() == 0
