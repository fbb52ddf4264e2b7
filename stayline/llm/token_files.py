"""Token ids of documents as Parquet list columns that can be read in parts.

A file holds documents in ascending ``doc_id`` order: the ids as one list column, dictionary-encoded (a page whose
dictionary grows too large falls back to delta encoding, Parquet's second format version), and the metadata
beside it. Row groups are small and pages hold few rows; column and offset indexes are written for each page. So
a reader of ``n_tokens`` never touches ids, and a filter on ``doc_id`` or ``start_in_file`` skips row groups and
pages.

Positions: ``part`` numbers the files in ``doc_id`` order, ``start_in_part`` counts the ids before a document in its
file. A document's place in the whole corpus is that plus the ids of all files before, summed from the metadata
columns alone (one row per file).
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stayline.llm.batches import list_array, pieces
from stayline.session import durable, scratch_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
REMEMBERED = 500_000  # distinct parts of texts a worker remembers; beyond that it starts anew
ROW_GROUP_BYTES = 8 << 20
PAGE_ROWS = 256
PAGE_BYTES = 256 << 10

WRITER = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.column.index.access": "true",
    "compression": "zstd",
}


def public_path(name: str) -> str:
    """Where the public vocabulary file ``name`` lies. Only callers that give no path of their own need that package."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Runs that the tokenizer's own pattern parts in lower-cased Latin-1 without control characters.
_LETTERS, _DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
#: 's, 't, 're, 've, 'm, 'll, 'd | a run of letters | a digit | a run of anything else but blanks
_BLANK, _LETTER, _DIGIT, _OTHER = range(4)
_CHARS = [chr(c) for c in range(256)]
_LOWER = "".join(_CHARS).lower().encode("latin-1")
_KINDS = np.array(
    [
        _BLANK if c in " \n" else _LETTER if re.match(f"[{_LETTERS}]", c) else _DIGIT if re.match(f"[{_DIGITS}]", c) else _OTHER
        for c in _CHARS
    ],
    np.uint8,
)
_SUFFIXES = [b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d"]


def part_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of lower-cased Latin-1 text begin, and which bytes belong to one."""
    kinds = _KINDS[data]
    inside = kinds != _BLANK
    begins = inside & ((kinds == _DIGIT) | (np.r_[np.uint8(_BLANK), kinds[:-1]] != kinds))
    # An apostrophe that begins a part takes the letters of a suffix along; other letters behind these are a part of their own.
    quotes = np.flatnonzero(begins & (data == ord("'")))
    padded = np.r_[data, np.zeros(2, np.uint8)]
    for suffix in _SUFFIXES:
        found = quotes[np.logical_and.reduce([padded[quotes + k] == c for k, c in enumerate(suffix)])]
        begins[found + 1] = False
        after = found + len(suffix)
        after = after[after < len(data)]
        begins[after] = inside[after]
    return np.flatnonzero(begins), inside


class WordTokenizer:
    """Ids of whole texts from the ids of their parts, each tokenized once for as long as it is remembered.

    The tokenizer cuts a normalised text into parts and merges within a part only, so the ids of a text are those of its
    parts in turn. Plain texts (Latin-1, no control characters but line feeds) are cut here, by the same rules: their normal form
    is the lower-cased text. Other texts are cut at blanks alone, which no part spans, and each word goes through the
    whole tokenizer. Parts are remembered as bytes, such words as strings.
    """

    def __init__(self, path: str, special_as_text: bool) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special_as_text
        self.parts = Tokenizer(self.whole.model)
        bytes_ = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), bytes_])
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)  # ids that end a part
        for token, number in self.whole.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes | str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.used = 0

    def remember(self, words: list[bytes] | list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        known = len(self.numbers)
        while len(self.ids) < self.used + len(ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        while len(self.starts) < known + len(words) + 1:
            self.starts = np.r_[self.starts, np.zeros_like(self.starts)]
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[known : known + len(words) + 1] = self.used + np.r_[0, np.cumsum(sizes)]
        self.numbers.update(zip(words, range(known, known + len(words)), strict=True))
        self.used += len(ids)

    def learn_parts(self, parts: list[bytes]) -> None:
        # encode() would also work out where in the text each id stands.
        joined = b" ".join(parts).decode("latin-1")
        ids = np.array(self.parts.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
        sizes = np.diff(np.r_[-1, np.flatnonzero(self.ends[ids])])
        if len(sizes) != len(parts):
            raise ValueError("the tokenizer does not mark the ends of words")
        self.remember(parts, ids, sizes)

    def learn_words(self, words: list[str]) -> None:
        found = [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        self.remember(words, np.array([i for ids in found for i in ids], np.int32), np.array([len(x) for x in found]))

    def numbered(self, words: list[bytes] | list[str], learn: Callable[[list], None]) -> np.ndarray:
        """The numbers of ``words``, each of which stands there once; ``learn`` gets those that are not remembered."""
        known = len(self.numbers)
        numbers = np.fromiter(map(self.numbers.get, words, itertools.repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            learn([words[i] for i in fresh.tolist()])
            numbers[fresh] = np.arange(known, known + len(fresh))
        return numbers

    def plain(self, text: str) -> bytes | None:
        """``text`` in Latin-1 if it can be cut here."""
        if text.isprintable() and not any(s in text for s in self.special):
            try:
                return text.encode("latin-1")
            except UnicodeEncodeError:
                pass
        return None

    def of_plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all parts of ``texts``, and how many each text has."""
        data = np.frombuffer(b"".join(t + b" " for t in texts).translate(_LOWER), np.uint8)
        begins, inside = part_bounds(data)
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        counts = np.diff(np.searchsorted(begins, np.r_[0, text_ends]))
        packed = np.cumsum(inside)  # place of each byte, from 1, when blanks are left out
        bounds = np.r_[packed[begins] - 1, packed[-1:]].astype(np.int64)
        buffers = [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])]
        coded = pa.Array.from_buffers(pa.large_binary(), len(begins), buffers).dictionary_encode()
        numbers = self.numbered(coded.dictionary.to_pylist(), self.learn_parts)
        return numbers[coded.indices.to_numpy()], counts

    def of_others(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of ``texts``, and how many each text has."""
        split = [[w for w in t.split(" ") if w] for t in texts]
        flat = list(itertools.chain.from_iterable(split))
        words = dict.fromkeys(flat)
        place = dict(zip(words, self.numbered(list(words), self.learn_words).tolist(), strict=True))
        return np.array([place[w] for w in flat], np.int64), np.array([len(x) for x in split], np.int64)

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ``end_id`` after each, and where each text begins and the last ends."""
        if len(self.numbers) > REMEMBERED:
            self.clear()
        lines = [(t or "").replace("\n", " ") for t in texts]
        raw = [self.plain(t) for t in lines]
        is_plain = np.array([r is not None for r in raw], bool)
        counts = np.zeros(len(texts), np.int64)
        plain, counts[is_plain] = self.of_plain([r for r in raw if r is not None])
        others, counts[~is_plain] = self.of_others([t for t, r in zip(lines, raw, strict=True) if r is None])
        numbers = np.empty(len(plain) + len(others), np.int64)
        from_plain = np.repeat(is_plain, counts)
        numbers[from_plain], numbers[~from_plain] = plain, others
        low = self.starts[numbers]
        sizes = self.starts[numbers + 1] - low
        word_ends = np.cumsum(sizes)
        total = int(word_ends[-1]) if len(numbers) else 0
        ids = self.ids[np.repeat(low - (word_ends - sizes), sizes) + np.arange(total)]
        text_ends = np.r_[0, word_ends][np.cumsum(counts)]
        ids = np.insert(ids, text_ends, end_id)
        return ids, np.r_[0, text_ends + np.arange(1, len(texts) + 1)]


_TOKENIZERS: dict[tuple[str, bool], WordTokenizer] = {}  # per Python worker


def tokenizer(path: str, special_as_text: bool = False) -> WordTokenizer:
    key = (path, special_as_text)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = WordTokenizer(*key)
    return _TOKENIZERS[key]


def encoded(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, part, start_in_part, n_tokens, ids) per document, one partition per ``part``, in ``doc_id`` order.

    Null ids come first; equal ids are ordered by text. Null and empty texts have the end id alone. Other
    columns are not read. An empty table gives no rows.
    """
    path = path or public_path(TOKENIZER)
    schema = "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = tokenizer(path), 0
        for batch in batches:
            for piece in pieces(batch):
                ids, offsets = words.encode(piece.column("text").to_pylist(), end_id)
                sizes = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"), piece.column("part"),
                        pa.array(seen + offsets[:-1], pa.int64()), pa.array(sizes, pa.int64()),
                        list_array(ids, offsets, pa.int32()),
                    ],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                seen += int(offsets[-1])

    return (
        docs.select(F.col("doc_id").cast("bigint"), "text")
        .repartitionByRange(F.col("doc_id"))
        .sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
        .mapInArrow(run, schema)
    )


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Writes ``encoded(docs)`` to ``folder``, one file per part."""
    encoded(docs, path, end_id).write.options(**WRITER).parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of ``folder`` with ``start``, the ids of all documents before. Read only what you select."""
    rows = spark.read.parquet(folder)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file; stored, so that the join knows its size and leaves the documents where they are.
    files = durable(
        rows.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select(
            "part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before")
        )
    )
    return rows.join(files, "part").select(
        "doc_id", (F.col("_before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids"
    )


def with_crc32(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): unsigned crc32 of the ids as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = lists.offsets.to_numpy()
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_digest(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes ``docs`` into token files in the shared folder and reads ``with_crc32`` back from them."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    write_tokens(docs, folder, path, end_id)
    return with_crc32(read_tokens(spark, folder))
