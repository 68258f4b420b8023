"""Token counts of flat token files, which hold nothing but ids and end-of-document ids.

A file is read in blocks of a fixed number of tokens, in parallel. Each block is searched
for the end id by one vectorised comparison. Documents cross blocks: a prefix scan over the
blocks of a file (tokens before, ends before, last end before) stitches them.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import text_runs, written

BLOCK_TOKENS = 1 << 17
# Blocks scanned together in the first of the two levels of the prefix scan.
CHUNK_BLOCKS = 1 << 12
_IDS = 8_192
_TASK_BYTES = 16 << 20
_NULL = -(2**63)
_TOKEN = np.dtype("<u2")


def _opened(path: str):
    """File system and inner path of a path or URI; Hadoop's ``file:/x`` is a local path."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
        return LocalFileSystem(), path
    return (LocalFileSystem(), path) if path.startswith("/") else FileSystem.from_uri(path)


def write_token_blocks(
    docs: DataFrame, ranks_file: str, pattern: str, end: int, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Tokenise ``text`` of (doc_id, text) into flat streams of 16-bit ids, one per task.

    A stream is all documents of the task, each closed by ``end`` (null texts are empty). It
    is stored in blocks: rows (kind 'tokens', file, no, data). The order of the documents is
    stored apart, as rows (kind 'ids', file, no, data). One write makes both, so a task that
    runs again replaces both.
    """
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_file, "rb"))}
    if max(ranks.values()) >= 2**16 or end >= 2**16 or end in set(ranks.values()):
        raise ValueError("ids must fit 16 bits, and the end id must be free")
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, pattern = shared.value
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        file = f"{TaskContext.get().partitionId():08d}"
        held = {"tokens": bytearray(), "ids": bytearray()}
        sizes = {"tokens": block_tokens * _TOKEN.itemsize, "ids": _IDS * 8}
        numbers = {"tokens": 0, "ids": 0}

        def rows(last: bool):
            for kind, data in held.items():
                while len(data) >= sizes[kind] or (last and data):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind]), pa.array([file]), pa.array([numbers[kind]], pa.int64()),
                         pa.array([bytes(data[: sizes[kind]])], pa.binary())],
                        names=["kind", "file", "no", "data"],
                    )
                    numbers[kind] += 1
                    del data[: sizes[kind]]

        for part in text_runs(batches, "text"):
            for ids in encoding.encode_ordinary_batch([t or "" for t in part.column("text").to_pylist()], num_threads=1):
                ids.append(end)
                held["tokens"] += np.array(ids, dtype=_TOKEN).tobytes()
            doc_ids = part.column("doc_id").fill_null(_NULL).to_numpy()
            held["ids"] += doc_ids.astype("<i8").tobytes()
            yield from rows(False)
        yield from rows(True)

    streams = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, "kind string, file string, no bigint, data binary")
    return written(streams, "token-blocks", compression="zstd")


def write_token_files(docs: DataFrame, ranks_file: str, pattern: str, end: int) -> tuple[str, DataFrame]:
    """Tokenise ``text`` of (doc_id, text) into flat files of 16-bit ids, one per task.

    A file is all documents of the task, each closed by ``end`` (null texts are empty), and
    nothing else. Gives the folder, and rows (kind 'ids', file, no, data) with the order of the
    documents, ``file`` being a name in the folder. A task that runs again writes a file of
    another name; only files that the rows name count.
    """
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_file, "rb"))}
    if max(ranks.values()) >= 2**16 or end >= 2**16 or end in set(ranks.values()):
        raise ValueError("ids must fit 16 bits, and the end id must be free")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((ranks, pattern))
    folder = scratch_path(spark, "token-files")
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(there)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, pattern = shared.value
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        name, raw, held, no = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}", None, bytearray(), 0

        def rows(last: bool):
            nonlocal no
            while len(held) >= _IDS * 8 or (last and held):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["ids"]), pa.array([name]), pa.array([no], pa.int64()), pa.array([bytes(held[: _IDS * 8])], pa.binary())],
                    names=["kind", "file", "no", "data"],
                )
                no += 1
                del held[: _IDS * 8]

        try:
            for part in text_runs(batches, "text"):
                if raw is None:
                    system, inner = _opened(f"{folder}/{name}")
                    raw = system.open_output_stream(inner)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for ids in encoding.encode_ordinary_batch(texts, num_threads=1):
                    ids.append(end)
                    raw.write(np.array(ids, dtype=_TOKEN).tobytes())
                held += part.column("doc_id").fill_null(_NULL).to_numpy().astype("<i8").tobytes()
                yield from rows(False)
        finally:
            if raw is not None:
                raw.close()
        yield from rows(True)

    return folder, written(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
            run, "kind string, file string, no bigint, data binary"
        ),
        "token-order", compression="zstd",
    )


def read_token_files(
    spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, names: DataFrame | None = None
) -> DataFrame:
    """Blocks (file, no, data) of raw files of 16-bit little-endian ids, of any size.

    Files are listed without their content; each task opens them and reads its own byte ranges.
    Paths are of file systems that pyarrow opens on the workers: shared folders, HDFS, S3, GCS.
    ``names`` (file): only files of these names are read.
    """
    size = block_tokens * _TOKEN.itemsize
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    if names is not None:
        files = files.join(names, F.substring_index("path", "/", -1) == F.col("file"), "left_semi")
    width = F.lit(_TOKEN.itemsize)
    ends = F.when(F.col("length") % width == 0, F.col("length")).otherwise(
        F.raise_error(F.concat("path", F.lit(" ends within a token")))
    )
    blocks = F.ceil(ends / F.lit(size)).cast("bigint")
    ranges = files.where("length > 0").withColumn("blocks", blocks).select(
        F.col("path").alias("file"), "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("no")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length, no in zip(*(batch.column(c).to_pylist() for c in ("file", "length", "no"))):
                system, inner = _opened(file)
                wanted = min(size, length - no * size)
                with system.open_input_file(inner) as raw:
                    data = raw.read_at(wanted, no * size)
                if len(data) != wanted:
                    raise ValueError(f"{file} is shorter than it was when listed")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([no], pa.int64()), pa.array([data], pa.binary())],
                    names=["file", "no", "data"],
                )

    # A fixed number of tasks: adaptive execution would join the short rows of ranges into one.
    total = files.agg(F.sum("length")).first()[0] or 0
    return ranges.repartition(max(1, -(-total // max(size, _TASK_BYTES))), "file", "no").mapInArrow(read, "file string, no bigint, data binary")


def _scanned(blocks: DataFrame, end: int) -> DataFrame:
    """Per block: its tokens and the places of its end ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(d.as_buffer(), dtype=_TOKEN) for d in batch.column("data")]
            ends = [np.flatnonzero(t == end) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("no"), pa.array([len(t) for t in tokens], pa.int64()),
                 pa.array(ends, pa.list_(pa.int64()))],
                names=["file", "no", "n_tokens", "ends"],
            )

    return blocks.select("file", "no", "data").mapInArrow(
        run, "file string, no bigint, n_tokens bigint, ends array<bigint>"
    )


def _prefix(blocks: DataFrame) -> DataFrame:
    """(file, no, first, ordinal, last_end): tokens, ends and last end before each block.

    Scanned within chunks of blocks, then over the totals of chunks: no window holds more
    than a chunk of blocks, or one row per chunk of a file.
    """
    rows = blocks.select(
        "file", "no", "n_tokens", F.size("ends").cast("bigint").alias("n"), F.get("ends", F.size("ends") - 1).alias("last"),
        F.floor(F.col("no") / CHUNK_BLOCKS).alias("chunk"),
    )
    before = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    inside = before.partitionBy("file", "chunk")
    none = F.lit(0).cast("bigint")
    rows = rows.withColumns({
        "_first": F.coalesce(F.sum("n_tokens").over(inside), none), "_ordinal": F.coalesce(F.sum("n").over(inside), none),
    })
    rows = rows.withColumn("_last", F.max(F.col("_first") + F.col("last")).over(inside))
    totals = rows.groupBy("file", "chunk").agg(
        F.sum("n_tokens").alias("t"), F.sum("n").alias("c"), F.max(F.col("_first") + F.col("last")).alias("e")
    )
    across = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({
        "t0": F.coalesce(F.sum("t").over(across), none), "c0": F.coalesce(F.sum("c").over(across), none),
    })
    totals = totals.withColumn("e0", F.max(F.col("t0") + F.col("e")).over(across)).select("file", "chunk", "t0", "c0", "e0")
    return rows.join(totals, ["file", "chunk"]).select(
        "file", "no", (F.col("t0") + F.col("_first")).alias("first"), (F.col("c0") + F.col("_ordinal")).alias("ordinal"),
        F.greatest(F.col("t0") + F.col("_last"), F.col("e0"), F.lit(-1)).alias("last_end"),
    )


def count_tokens(blocks: DataFrame, end: int) -> DataFrame:
    """Documents of token blocks (file, no, data): file, ordinal, start, n_tokens, closed.

    ``no`` counts the blocks of a file from 0; ``start`` and ``n_tokens`` are in tokens and
    leave out the end id. Tokens after a file's last end are a document too, with ``closed``
    false. Empty files have no documents.
    """
    scanned = written(_scanned(blocks, end), "scanned-blocks")
    placed = scanned.join(_prefix(scanned), ["file", "no"])
    ends = F.transform("ends", lambda e: e + F.col("first"))
    # What starts documents: the place after each earlier end.
    starts = F.concat(F.array(F.col("last_end") + 1), F.transform(F.slice(ends, 1, F.greatest(F.size("ends") - 1, F.lit(0))), lambda e: e + 1))
    closed = placed.where(F.size("ends") > 0).select(
        "file", "ordinal", F.posexplode(F.arrays_zip(ends.alias("end"), starts.alias("start"))).alias("i", "d")
    ).select(
        "file", (F.col("ordinal") + F.col("i")).alias("ordinal"), F.col("d.start").alias("start"),
        (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("closed"),
    )
    tails = placed.groupBy("file").agg(
        F.sum("n_tokens").alias("n"), F.sum(F.size("ends")).cast("bigint").alias("ordinal"),
        F.max(F.greatest(F.col("first") + F.get("ends", F.size("ends") - 1), F.col("last_end"))).alias("last"),
    ).where("last + 1 < n").select(
        "file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("n") - F.col("last") - 1).alias("n_tokens"),
        F.lit(False).alias("closed"),
    )
    return closed.unionByName(tails)


def document_order(stored: DataFrame) -> DataFrame:
    """(file, ordinal, doc_id) of what ``write_token_blocks`` stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, no, data in zip(*(batch.column(c) for c in range(3))):
                ids = np.frombuffer(data.as_buffer(), dtype="<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file.as_py()] * len(ids)), pa.array(no.as_py() * _IDS + np.arange(len(ids))),
                     pa.array(ids, mask=ids == _NULL)],
                    names=["file", "ordinal", "doc_id"],
                )

    return stored.where("kind = 'ids'").select("file", "no", "data").mapInArrow(
        run, "file string, ordinal bigint, doc_id bigint"
    )
