"""Token counts of flat token files by a separator scan.

A flat token file is the ids of many documents in a row, little-endian unsigned 16- or 32-bit numbers, an
end-of-document id after each, with no index and no header. Files are read in blocks, each by a task of its
own, which finds the end ids of its block with one vectorised search. A document may begin in one block and end in
another, so the blocks' summaries (how many ends, where the last one is) are combined by a prefix scan: it gives each block
the last end before it and the number of documents before it, and with that the block's own ends become counts.

The files are a Python data source: tasks write and read byte ranges by pyarrow's file systems, in whatever store the
folder's URI names. Each job's files carry its number, and the job ends with a list of those that count, the manifest. Readers take
a numbered file only if a manifest has it; other files of the folder are read as they are, and no job touches them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from stayline.llm.batches import list_array, pieces
from stayline.llm.token_files import TOKENIZER, public_path, tokenizer
from stayline.session import durable, scratch_path

END_ID = 49407  # <|endoftext|>; its string in a text is encoded as ordinary text, so no text holds this id
BLOCK_BYTES = 8 << 20  # a multiple of every width
MANIFEST = "_committed-"  # with the job's number; one file name a line
_NUMBERED = re.compile(r"part-([0-9a-f]{32})-")
WIDTHS = {"u2": np.dtype("<u2"), "u4": np.dtype("<u4"), "i8": np.dtype("<i8")}


def store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


def listed(files: fs.FileSystem, base: str) -> list[fs.FileInfo]:
    """The files of a folder that count, in order of their paths."""
    found = [f for f in files.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.is_file]
    committed: set[str] = set()
    for f in found:
        if f.base_name.startswith(MANIFEST):
            with files.open_input_stream(f.path) as stream:
                committed.update(stream.read().decode().split("\n"))
    counts = [f for f in found if not f.base_name.startswith(MANIFEST)]
    return sorted((f for f in counts if not _NUMBERED.match(f.base_name) or f.base_name in committed), key=lambda f: f.path)


@dataclass
class Block(InputPartition):
    path: str
    offset: int
    size: int


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class BlockReader(DataSourceReader):
    """(file, at, ends, n): per block its file and first position, the positions of the wanted id, and its length.

    With option ``values`` the numbers themselves stand in ``ends``. Positions count numbers from the file's start.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.suffix = options["path"], options["suffix"]
        self.kind = WIDTHS[options["width"]]
        self.block = int(options.get("block_bytes", BLOCK_BYTES)) // 8 * 8
        self.wanted = None if options.get("values") else int(options["end_id"])

    def partitions(self) -> list[InputPartition]:
        files, base = store(self.folder)
        return [
            Block(f.path, low, min(self.block, f.size - low))
            for f in listed(files, base)
            if f.path.endswith(self.suffix)
            for low in range(0, f.size, self.block)
        ] or [Block("", 0, 0)]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        if not block.size:
            return
        files, _ = store(self.folder)
        with files.open_input_file(block.path) as f:
            raw = f.read_at(block.size, block.offset)
        numbers = np.frombuffer(raw, self.kind, len(raw) // self.kind.itemsize)
        at = block.offset // self.kind.itemsize
        found = numbers.astype(np.int64) if self.wanted is None else np.flatnonzero(numbers == self.wanted) + at
        name = block.path.rsplit("/", 1)[-1].removesuffix(self.suffix)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name]), pa.array([at], pa.int64()),
                list_array(found, np.array([0, len(found)]), pa.int64()), pa.array([len(numbers)], pa.int64()),
            ],
            names=["file", "at", "ends", "n"],
        )


class TokenWriter(DataSourceArrowWriter):
    """Writes (doc_id, ids) to a ``.tokens`` and an ``.ids`` file per task.

    What failed attempts of this job have left is removed at its end, and all of this job's files if it fails; files of other jobs, or
    of anyone else, stay as they are.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.kind, self.end = options["path"], WIDTHS[options["width"]], int(options["end_id"])
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{self.job}-{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}"
        files, base = store(self.folder)
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/{name}.tokens") as tokens, files.open_output_stream(f"{base}/{name}.ids") as ids:
            for batch in batches:
                lists = batch.column("ids")
                at = lists.offsets.to_numpy()
                tokens.write(lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(self.kind).tobytes())
                ids.write(batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        return Written([f"{name}.tokens", f"{name}.ids"])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = store(self.folder)
        files.create_dir(base, recursive=True)
        known = sorted(n for m in messages if m for n in m.names)
        with files.open_output_stream(f"{base}/{MANIFEST}{self.job}") as manifest:
            manifest.write("\n".join(known).encode())
        self.remove(set(known))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.remove(set())

    def remove(self, kept: set[str]) -> None:
        """Removes this job's files but ``kept``."""
        files, base = store(self.folder)
        for f in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if f.is_file and f.base_name.startswith(f"part-{self.job}-") and f.base_name not in kept:
                files.delete_file(f.path)


class FlatTokens(DataSource):
    """Format ``flat_tokens``. Options: path, width (u2 or u4), end_id; to read also suffix, values, block_bytes."""

    @classmethod
    def name(cls) -> str:
        return "flat_tokens"

    def schema(self) -> str:
        return "file string, at bigint, ends array<bigint>, n bigint"

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TokenWriter(dict(self.options))


def encoded(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids) with the end id last, in the order and partitions of ``docs``; a null text has the end id alone."""
    path = path or public_path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path, special_as_text=True)
        for batch in batches:
            for piece in pieces(batch):
                ids, offsets = words.encode(piece.column("text").to_pylist(), end_id)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), list_array(ids, offsets, pa.int32())], names=["doc_id", "ids"]
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def write_flat(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, width: str = "u2") -> None:
    """Writes the ids of ``docs`` as flat token files, and beside each the doc ids in the same order (null: -1). Files that
    ``folder`` already has stay."""
    docs.sparkSession.dataSource.register(FlatTokens)
    encoded(docs, path, end_id).write.format("flat_tokens").mode("append").options(
        path=folder, width=width, end_id=str(end_id)
    ).save()


def token_counts(
    spark: SparkSession, folder: str, end_id: int = END_ID, width: str = "u2", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(file, doc_no, start, n_tokens, complete) per document of the flat token files in ``folder``.

    ``doc_no`` numbers a file's documents from 0, ``start`` is the position of the first id in the file, ``n_tokens`` counts the end id.
    A file that does not end with the end id has one more document, not ``complete``. A document may span any number of blocks.
    Bytes beyond the last whole number are left out. An empty folder, or an empty file, gives no rows.
    """
    spark.dataSource.register(FlatTokens)
    options = {"path": folder, "width": width, "end_id": str(end_id), "suffix": ".tokens", "block_bytes": str(block_bytes)}
    blocks = durable(spark.read.format("flat_tokens").options(**options).load())
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    some = F.size("ends") > 0
    summary = blocks.select(
        "file", "at", "n", F.size("ends").cast("bigint").alias("_ends"),
        F.when(some, F.element_at("ends", -1)).alias("_last"),
    )
    scanned = durable(
        summary.select(
            "file", "at", F.coalesce(F.sum("_ends").over(before), F.lit(0)).alias("_docs"),
            F.coalesce(F.max("_last").over(before), F.lit(-1)).alias("_previous"),
        )
    )
    ended = blocks.where(some).join(scanned, ["file", "at"]).select(
        "file", "_docs", F.posexplode(F.arrays_zip("ends", F.concat(F.array("_previous"), F.expr("slice(ends, 1, size(ends) - 1)")).alias("p"))).alias("_i", "_e")
    ).select(
        "file", (F.col("_docs") + F.col("_i")).alias("doc_no"), (F.col("_e.p") + 1).alias("start"),
        (F.col("_e.ends") - F.col("_e.p")).alias("n_tokens"), F.lit(True).alias("complete"),
    )
    tail = summary.groupBy("file").agg(
        F.sum("_ends").alias("doc_no"), (F.coalesce(F.max("_last"), F.lit(-1)) + 1).alias("start"), F.max(F.col("at") + F.col("n")).alias("_all")
    ).where("start < _all").select(
        "file", "doc_no", "start", (F.col("_all") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete")
    )
    return ended.unionByName(tail)


def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(file, doc_no, doc_id) of the files beside the flat token files; -1 is null again."""
    spark.dataSource.register(FlatTokens)
    blocks = spark.read.format("flat_tokens").options(path=folder, width="i8", suffix=".ids", values="1").load()
    return blocks.select("file", "at", F.posexplode("ends").alias("_i", "_id")).select(
        "file", (F.col("at") + F.col("_i")).alias("doc_no"), F.when(F.col("_id") != -1, F.col("_id")).alias("doc_id")
    )


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) per row of ``docs``, counted in flat token files of them in the shared folder.

    Null and empty texts count 1, the end id. Repeated rows are counted each. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "flat")
    write_flat(docs, folder, path)
    return token_counts(spark, folder).join(document_ids(spark, folder), ["file", "doc_no"]).select("doc_id", "n_tokens")
