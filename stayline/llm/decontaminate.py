"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

Normal form: the words of a text (see ``words``), lower-cased, with one blank between and around them. Each run of
``WINDOW`` words of an item is a pattern; an item of fewer words, but not none, is one pattern. Every document is
scanned once; a match ends at a blank, so the blanks before it number its words, and the words' places in
the text give the span in the original.

A benchmark of up to ``SHARD_CHARS`` characters is one automaton; its texts go to every task, which makes the patterns of them.
Larger ones are cut by a hash into shards of about that size. The documents are scanned for one shard after the other, what was found
so far is stored between them, so the driver, a plan and a task hold one shard at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm import words
from stayline.llm.batches import joined, pieces
from stayline.session import durable

WINDOW = 13
HIT_SHARE = 20  # contaminated if at least one word in this many is hit
SHARD_CHARS = 4_000_000  # characters of benchmark texts in one automaton

Ranges = list[tuple[int, int, int, int]]  # words from, to; characters from, to


def normal_words(text: str | None) -> list[str]:
    data, _ = joined(pa.array([text or ""], pa.string()))
    return words.NORMAL[data].tobytes().decode("utf-8").split()


def windows(items: Iterable[tuple[str, str | None]], width: int = WINDOW) -> dict[str, tuple[int, list[str]]]:
    """Pattern to its number of words and the items that hold it."""
    out: dict[str, tuple[int, list[str]]] = {}
    for item, text in items:
        found = normal_words(text)
        size = min(width, len(found))
        for i in range(len(found) - size + 1 if size else 0):
            holders = out.setdefault(f" {' '.join(found[i : i + size])} ", (size, []))[1]
            if item not in holders[-1:]:
                holders.append(item)
    return out


def automaton(patterns: dict[str, tuple[int, list[str]]]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for pattern, value in patterns.items():
        machine.add_word(pattern, value)
    if patterns:
        machine.make_automaton()
    return machine


def merged(ranges: Ranges) -> Ranges:
    """The same words in disjoint ranges in order."""
    out: Ranges = []
    for r in sorted(ranges):
        if out and r[0] <= out[-1][1]:
            last = out[-1]
            out[-1] = (last[0], max(last[1], r[1]), last[2], max(last[3], r[3]))
        else:
            out.append(r)
    return out


def char_offsets(data: np.ndarray) -> np.ndarray:
    """For each byte of a UTF-8 text, how many characters start before it; one more entry for the end."""
    return np.r_[0, np.cumsum((data & 0xC0) != 0x80)]


Items = list[tuple[str, str | None]]


def scan(docs: DataFrame, items: Items) -> DataFrame:
    """Adds what one automaton of ``items`` finds to ``_scan_words``, ``_scan_ranges`` and ``_scan_items``."""
    places = {c: docs.columns.index(c) for c in ("_scan_words", "_scan_ranges", "_scan_items")}
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = windows(items)
        machine = automaton(patterns)
        for batch in batches:
            for piece in pieces(batch):
                data, bounds = joined(piece.column("text"))
                first, last = words.word_bounds(data)
                counts = np.diff(np.searchsorted(first, bounds))
                inside = words.IS_WORD[data]
                kept = inside | np.r_[False, inside[:-1]]  # each word and the byte after it
                normal = words.NORMAL[data][kept]
                at = np.r_[0, np.cumsum(kept)][bounds]
                word_at = np.searchsorted(first, bounds)
                ranges, held = piece.column("_scan_ranges").to_pylist(), piece.column("_scan_items").to_pylist()
                for i in range(piece.num_rows if patterns else 0):
                    text = " " + normal[at[i] : at[i + 1]].tobytes().decode("utf-8")
                    found = list(machine.iter(text))
                    if not found:
                        continue
                    blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
                    ends = np.searchsorted(blanks, [end for end, _ in found])  # words up to the match's end
                    chars = char_offsets(data[bounds[i] : bounds[i + 1]])
                    new = [tuple(ranges[i][k : k + 4]) for k in range(0, len(ranges[i]), 4)]
                    hit_words = merged([(int(e) - n, int(e), 0, 0) for e, (_, (n, _)) in zip(ends, found, strict=True)])
                    base, start = word_at[i], bounds[i]
                    for a, b, _, _ in hit_words:
                        new.append((a, b, int(chars[first[base + a] - start]), int(chars[last[base + b - 1] - start])))
                    ranges[i] = [x for r in merged(new) for x in r]
                    held[i] = sorted({*held[i], *(x for _, (_, own) in found for x in own)})
                columns = list(piece.columns)
                columns[places["_scan_words"]] = pa.array(counts, pa.int64())
                columns[places["_scan_ranges"]] = pa.array(ranges, kind)
                columns[places["_scan_items"]] = pa.array(held, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=piece.schema.names)

    return docs.mapInArrow(run, docs.schema)


def shards(benchmark: DataFrame) -> Iterator[Items]:
    """(item, text) of the benchmark, a bounded part at a time; one empty part if there are none."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-chars // SHARD_CHARS))
    for k in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        yield [(r["item"], r["text"]) for r in own.collect()]


def scanned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (array, sorted as strings), spans (array of start, end) and
    contaminated.

    Spans are runs of hit words in the original text, in characters, end exclusive. Needs text; other columns are
    kept, clashing ones replaced. A null or empty text has no words and is clean. Repeated rows are judged alike.
    Items with null or empty text have no pattern; an item without id is called "null". An empty benchmark hits
    nothing.
    """
    added = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")
    own = [c for c in docs.columns if c not in added]
    # All other columns in one, so that theirs and the inner names cannot clash.
    rows = docs.select(
        F.struct(*[c for c in own if c != "text"]).alias("_scan_row") if own != ["text"] else F.lit(None).cast("string").alias("_scan_row"),
        "text",
        F.lit(0).cast("bigint").alias("_scan_words"),
        F.array().cast("array<bigint>").alias("_scan_ranges"),
        F.array().cast("array<string>").alias("_scan_items"),
    )
    for k, items in enumerate(shards(benchmark)):
        rows = scan(durable(rows) if k else rows, items)
    runs = F.sequence(F.lit(0), (F.size("_scan_ranges") / 4).cast("int") - 1)
    runs = F.when(F.size("_scan_ranges") > 0, runs).otherwise(F.array().cast("array<int>"))

    def part(i, k):
        return F.col("_scan_ranges")[i * 4 + k]

    hit = F.aggregate(runs, F.lit(0).cast("bigint"), lambda s, i: s + part(i, 1) - part(i, 0))
    spans = F.transform(runs, lambda i: F.struct(part(i, 2).alias("start"), part(i, 3).alias("end")))
    found = rows.select(
        "_scan_row", "text",
        F.col("_scan_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_scan_items").cast("bigint").alias("n_items"),
        F.array_sort("_scan_items").alias("items"),
        spans.alias("spans"),
    ).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * HIT_SHARE >= F.col("n_words"))
    )
    return found.select(*[F.col("text") if c == "text" else F.col("_scan_row")[c].alias(c) for c in own], *added)
