"""Token counts per document from flat token files, by a separator scan.

A flat file holds token ids of fixed width, one document after another, each ended by an end-of-document id; there is no
index. A file is read in ranges of BLOCK_BYTES that cut documents anywhere, each by a task of its own, whatever the file's size. Within a block, one vectorised comparison finds all
separators; a block is summed up by its number of tokens and separators, the tokens before its first and after its
last separator, and the lengths between. A prefix scan over these few numbers per block (running sums of tokens and
separators, running place of the last separator) gives each document's ordinal, place and length, also of documents
that span many blocks.

Scale: blocks are independent tasks and are read by range, so a file may be of any size; the scan has one row a block and runs per
stream (file set), so many streams go in parallel and a stream of a million blocks is still a small window. Nothing is
collected. A compressed file (.zst) can only be read from its start and is one block.

`write_token_files` makes such files from documents, through the file system of the given URI, so on a cluster it must
be a shared one; a task writes under a name of its own and renames, so retries and lost executors leave whole files.

Defined results: null and empty texts are documents of 0 tokens. Tokens after the last separator of a stream are an open
document (closed = false). An empty block or file adds nothing. A file whose length is no multiple of the width fails, as do writing ids
that do not fit into the width, and an end-of-document id that the vocabulary has.
Repeated rows are counted one by one; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _texts, read_ranks, worker_bpe
from .common import checkpoint_dir, cut, remove

EOD = 50_256
WIDTH = 2
BLOCK_TOKENS = 2 << 20
BLOCK_BYTES = 32 << 20
NAME = r"tokens-(\d+)-(\d+)\.bin(?:\.zst)?$"


def write_token_files(docs: DataFrame, uri: str, ranks_path: str, pattern: str, eod: int = EOD, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS, compress: bool = True) -> DataFrame:
    """Writes files tokens-STREAM-BLOCK.bin under uri; returns (stream, ordinal, doc_id), materialised.

    compress: each file is one zstd frame around the flat ids.
    """
    data = open(ranks_path, "rb").read()
    known = set(read_ranks(data).values())
    if max(known, default=0) >= 1 << 8 * width or not 0 <= eod < 1 << 8 * width:
        raise ValueError(f"ids up to {max(max(known, default=0), eod)} do not fit into {width} bytes")
    if eod in known:
        raise ValueError(f"the end-of-document id {eod} is one of the vocabulary")
    shared = docs.sparkSession.sparkContext.broadcast(data)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        from pyarrow import fs

        bpe = worker_bpe(shared.value, pattern)
        system, root = fs.FileSystem.from_uri(uri)
        system.create_dir(root, recursive=True)
        stream, ordinal, block = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        size = 0

        def flush(tokens: np.ndarray) -> None:
            nonlocal block
            name = f"{root}/tokens-{stream:06d}-{block:08d}.bin" + ".zst" * compress
            own = f"{root}/_{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(own, compression="zstd" if compress else None) as f:
                f.write(tokens.astype(f"<u{width}").tobytes())
            system.move(own, name)
            block += 1

        for b in batches:
            for text in _texts(b.column("text")):
                held.append(np.frombuffer(bpe.encode_packed(text), "<u4"))
                held.append(np.asarray([eod], "<u4"))
                size += len(held[-2]) + 1
                if size >= block_tokens:
                    flat = np.concatenate(held)
                    while len(flat) >= block_tokens:
                        flush(flat[:block_tokens])
                        flat = flat[block_tokens:]
                    held, size = [flat], len(flat)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, stream), pa.int32()), pa.array(np.arange(ordinal, ordinal + n), pa.int64()), b.column("doc_id")], names=["stream", "ordinal", "doc_id"])
            ordinal += n
        if size:
            flush(np.concatenate(held))

    return cut(docs.select("doc_id", "text").mapInArrow(run, f"stream int, ordinal long, doc_id {kind}"))


def token_blocks(spark: SparkSession, uri: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(stream, block, part, path, begin, length, zst): ranges of the files under uri, not their bytes. Names tokens-STREAM-BLOCK.bin make
    streams; any other file is a stream of its own. block and part are the place in the stream."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin*").load(uri).select("path", F.col("length").alias("size"))  # contents are not read
    named, zst = F.col("path").rlike(NAME), F.col("path").endswith(".zst")
    step = F.lit(block_bytes - block_bytes % 64)  # a multiple of any width
    begins = F.when(zst | (F.col("size") <= step), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step.cast("long")))
    return files.select(
        F.when(named, F.regexp_extract("path", NAME, 1)).otherwise(F.col("path")).alias("stream"),
        F.when(named, F.regexp_extract("path", NAME, 2)).otherwise(F.lit("0")).cast("long").alias("block"),
        "path", "size", zst.alias("zst"), F.posexplode(begins).alias("part", "begin"),
    ).withColumn("length", F.when(F.col("zst"), F.col("size")).otherwise(F.least(step, F.col("size") - F.col("begin")))).drop("size")


SUMMARY = "stream string, block long, part int, n_tokens long, n_ends long, head long, tail long, lengths array<int>"


READ = ("stream", "block", "part", "path", "begin", "length", "zst")


def scan_blocks(blocks: DataFrame, eod: int = EOD, width: int = WIDTH, tasks: int = 200) -> DataFrame:
    """One row (SUMMARY) per block: head and tail are the tokens before the first and after the last separator; lengths those between."""

    def run(batches):
        import zstandard
        from pyarrow import fs

        systems: dict = {}

        def content(path: str, begin: int, length: int) -> bytes:
            root = path.split("/", 3)[2] if "://" in path else ""
            key = (path.split(":", 1)[0], root)
            if key not in systems:
                systems[key] = fs.FileSystem.from_uri(path)[0]
            with systems[key].open_input_file(fs.FileSystem.from_uri(path)[1]) as f:
                f.seek(begin)
                return f.read(length)

        for b in batches:
            rows = []
            for stream, block, part, path, begin, length, zst in zip(*(b.column(c).to_pylist() for c in READ), strict=True):
                data = content(path, begin, length)
                if zst:
                    data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
                if len(data) % width:
                    raise ValueError(f"{len(data)} bytes of {path} are no multiple of {width}")
                ids = np.frombuffer(data, f"<u{width}")
                at = np.flatnonzero(ids == eod)
                if len(at):
                    rows.append((stream, block, part, len(ids), len(at), int(at[0]), len(ids) - 1 - int(at[-1]), (np.diff(at) - 1).astype("i4")))
                else:
                    rows.append((stream, block, part, len(ids), 0, len(ids), len(ids), np.empty(0, "i4")))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SUMMARY.split(", ")])

    # The rows are a few names a file: they are dealt to all tasks, since reading is what takes time.
    return blocks.select(*READ).repartition(tasks).mapInArrow(run, SUMMARY)


def documents_of(summary: DataFrame) -> DataFrame:
    """(stream, ordinal, n_tokens, begin, closed) of every document, by a prefix scan over the blocks of a stream."""
    order = Window.partitionBy("stream").orderBy("block", "part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    scanned = (
        summary.withColumn("at", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
        .withColumn("ordinal", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
        .withColumn("after_last", F.when(F.col("n_ends") > 0, F.col("at") + F.col("n_tokens") - F.col("tail")))
        .withColumn("open_since", F.coalesce(F.max("after_last").over(before), F.lit(0)))
        .withColumn("is_last", F.lead("block").over(order).isNull())
    )
    first = scanned.where("n_ends > 0").select("stream", "ordinal", (F.col("at") + F.col("head") - F.col("open_since")).alias("n_tokens"), F.col("open_since").alias("begin"), F.lit(True).alias("closed"))
    inner = scanned.where("n_ends > 1").select("stream", "ordinal", "at", "head", F.posexplode("lengths").alias("i", "n"))
    # A document's place: the separators before it in the block and the lengths between add up.
    running = F.sum(F.col("n") + 1).over(Window.partitionBy("stream", "ordinal").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    inner = inner.select("stream", (F.col("ordinal") + F.col("i") + 1).alias("o"), F.col("n").cast("long").alias("n_tokens"), (F.col("at") + F.col("head") + 1 + F.coalesce(running, F.lit(0))).alias("begin"), F.lit(True).alias("closed"))
    rest = F.coalesce(F.col("after_last"), F.col("open_since"))
    end = F.col("at") + F.col("n_tokens")
    last = scanned.where(F.col("is_last") & (end > rest)).select("stream", (F.col("ordinal") + F.col("n_ends")).alias("ordinal"), (end - rest).alias("n_tokens"), rest.alias("begin"), F.lit(False).alias("closed"))
    return first.unionByName(inner.withColumnRenamed("o", "ordinal")).unionByName(last)


def count_tokens(spark: SparkSession, uri: str, eod: int = EOD, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    blocks = token_blocks(spark, uri, block_bytes)
    facts = blocks.agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).first()
    tasks = max(1, min(facts.n, (facts.bytes or 0) // (4 << 20)))
    return documents_of(cut(scan_blocks(blocks, eod, width, tasks)))


def count_documents(docs: DataFrame, ranks_path: str, pattern: str, uri: str | None = None) -> DataFrame:
    """doc_id, n_tokens, stream, ordinal, begin: documents are written as flat files in the shared folder, which are then scanned."""
    spark = docs.sparkSession
    own = uri is None
    uri = uri or f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri
    written = write_token_files(docs, uri, ranks_path, pattern)
    found = count_tokens(spark, uri).withColumn("stream", F.col("stream").cast("int"))
    if own:  # the scan's sums are materialised
        remove(spark, uri)
    return written.join(found, ["stream", "ordinal"]).select("doc_id", "n_tokens", F.col("stream").cast("long").alias("stream"), "ordinal", "begin")
