"""Language ID by compression: the language whose zstandard dictionary makes a text smallest.

Each language's dictionary is raw text: the beginnings of a bounded sample of its labelled documents, lower-cased
with all but letters turned into single blanks, of which the first ``DICTIONARY_BYTES`` in sample order are kept. A text in the same form is compressed whole with each language, in even
blocks of at most ``BLOCK_BYTES`` that know nothing of one another: a dictionary saves a bounded number of bytes per
compression, so only sums over blocks keep the margin from shrinking with the text's length. Each block is
followed by the same short padding, so that even a text of one word makes a compressed block. The smallest sum
wins; a text whose best two sums lie closer than ``MIN_MARGIN`` is rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 128  # documents a language's dictionary draws on at most, lowest hash first
SAMPLE_CHARS = 1024  # characters of each
DICTIONARY_BYTES = 32 << 10  # the bound that decides if beginnings are long: about 32 full ones
BLOCK_BYTES = 8 << 10  # of a text, compressed together
MIN_MARGIN = 0.005  # of the second smallest size
SHARPNESS = 100.0  # how fast the score rises with the margin
UNKNOWN = "und"
_PADDING = b" " + bytes(64)
_NO_LETTERS = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 is 1. A null id counts as held out: nothing is learned from it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def normal(text: str) -> str:
    return _NO_LETTERS.sub(" ", text.lower()).strip()


@dataclass(frozen=True)
class Dictionaries:
    """Raw dictionary content by language."""

    content: dict[str, bytes]

    def compressors(self) -> list[tuple[str, object]]:
        import zstandard as zstd

        how = zstd.ZstdCompressionParameters(
            window_log=18, chain_log=15, hash_log=15, search_log=3, min_match=4, target_length=8,
            strategy=zstd.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        out = []
        for lang, content in sorted(self.content.items()):
            held = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=how)
            out.append((lang, zstd.ZstdCompressor(compression_params=how, dict_data=held)))
        return out


def blocks(data: bytes) -> list[bytes]:
    """``data`` in the fewest blocks of at most ``BLOCK_BYTES``, of even size."""
    size = -(-len(data) // -(-len(data) // BLOCK_BYTES))
    return [data[i : i + size] for i in range(0, len(data), size)]


def learn(labelled: DataFrame) -> Dictionaries:
    """Dictionaries from ``labelled`` (doc_id, text, lang). Rows without text or language teach nothing.

    The driver receives ``SAMPLE_DOCS`` beginnings per language at most. Equal beginnings count once. Ties of the
    order are broken by the text, so the choice does not depend on the partitions.
    """
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "head")
    rows = (
        labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .select("lang", "doc_id", F.substring("text", 1, 4 * SAMPLE_CHARS).alias("head"))
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= SAMPLE_DOCS)
        .collect()
    )
    heads: dict[str, dict[str, None]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["_n"])):
        if head := normal(row["head"])[:SAMPLE_CHARS]:
            heads.setdefault(row["lang"], {})[head] = None
    return Dictionaries(
        {lang: " ".join(own).encode()[:DICTIONARY_BYTES].ljust(8, b" ") for lang, own in heads.items()}
    )


def classify(docs: DataFrame, dictionaries: Dictionaries) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), margin and rejected.

    Reads text alone; other columns are kept, clashing ones replaced. A text that is null or has no letter, and any
    text if no language was learned, is ``und`` with score 0, margin 0, rejected. Equal sizes go to the first
    language by name with margin 0, and are rejected. A single learned language wins with margin 1. Equal texts get
    equal results.
    """
    added = ["lang_pred", "score", "margin", "rejected"]
    own = [c for c in docs.columns if c not in added]
    schema = docs.select(*own).schema.add("lang_pred", "string").add("score", "double")
    schema = schema.add("margin", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = dictionaries.compressors()
        for batch in batches:
            langs, scores, margins, rejected = [], [], [], []
            for text in batch.column("text"):
                plain = normal(text.as_py() or "")
                if not machines or not any(map(str.isalpha, plain)):
                    found = (UNKNOWN, 0.0, 0.0, True)
                else:
                    parts = [part + _PADDING for part in blocks(plain.encode())]
                    sizes = sorted((sum(len(m.compress(part)) for part in parts), lang) for lang, m in machines)
                    best, lang = sizes[0]
                    margin = (sizes[1][0] - best) / sizes[1][0] if len(sizes) > 1 else 1.0
                    rivals = sum(math.exp(-SHARPNESS * (s - best) / best) for s, _ in sizes)
                    found = (lang, 1 / rivals, margin, margin < MIN_MARGIN)
                for column, value in zip((langs, scores, margins, rejected), found, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in own),
                    pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                    pa.array(margins, pa.float64()), pa.array(rejected, pa.bool_()),
                ],
                names=[*own, *added],
            )

    return docs.select(*own).mapInArrow(run, schema)
