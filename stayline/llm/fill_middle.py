"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put together in another order.

A text's units are runs of characters that are not blanks, each with the blanks before it; blanks at the end are a unit
of their own. Units are found in the bytes of many texts at once, so cuts are byte places. Characters are counted with a
sparse index of exceptions: only the places of characters of several bytes and how many bytes too many they have, summed
up. A place's character number is the place less the excess before it, found by binary search, and back again;
between exceptions, and in a text of ASCII alone, it is plain arithmetic.

Form and cuts are drawn from a hash of the document's id: the same at any partitioning, and in any later run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm import words
from stayline.llm.batches import joined, pieces

SEED = 42
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
RATE = 50  # per cent of texts that are cut
SPM = 80  # per cent of those that begin with the suffix


# ---- bytes and characters --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Exceptions:
    """Where the characters of several bytes of a UTF-8 text are. ``lead`` are their byte places, ``excess`` the bytes beyond one
    of each, summed up to and with it."""

    lead: np.ndarray
    excess: np.ndarray

    @staticmethod
    def of(data: np.ndarray) -> Exceptions:
        lead = np.flatnonzero(data >= 0xC0)
        more = 1 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        return Exceptions(lead, np.cumsum(more))

    def chars(self, places: np.ndarray) -> np.ndarray:
        """Characters before each byte place (a character's first byte, or the end)."""
        before = np.searchsorted(self.lead, places)
        return places - np.r_[0, self.excess][before]

    def bytes(self, numbers: np.ndarray) -> np.ndarray:
        """Byte places of the characters with these numbers; the inverse of ``chars``."""
        # The number of each exception; those before a character shift it.
        own = self.lead - np.r_[0, self.excess][:-1] if len(self.lead) else self.lead
        return numbers + np.r_[0, self.excess][np.searchsorted(own, numbers)]


# ---- units, cuts, forms ------------------------------------------------------------------------------------


def unit_ends(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places where units end, and the number of the first unit of each text (and of all).

    ``data`` has one blank after each text, ``bounds`` are the texts' first bytes and the end of all.
    """
    _, last = words.word_bounds(data, words.NOT_BLANK)
    stop = bounds[1:] - 1
    # A text that ends with blanks has one more unit, up to its end.
    tail = (stop > bounds[:-1]) & ~words.NOT_BLANK[data[np.maximum(stop - 1, 0)]]
    ends = np.sort(np.r_[last, stop[tail]])
    # An empty text's stop equals its start, and a text's last unit ends at its stop at the latest.
    return ends, np.r_[0, np.searchsorted(ends, stop, side="right")]


def draws(key: str, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 of a document's id."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def rearranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restored(form: str, output: bytes) -> bytes:
    """The text again. No cut text holds a mark, and no mark can arise across the seam of a part and a mark."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output (text).

    Needs doc_id and text; other columns are kept, those that clash with the added ones are replaced. A text that is null
    or empty, or holds a mark, stays plain, with null for both lengths; a null text's output is empty. Rows without id are
    drawn as the id ``null``; repeated rows are drawn alike. An empty table gives no rows.
    """
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    own = [c for c in docs.columns if c not in added]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*own).alias("row"), key.alias("key"), "text")
    schema = rows.select("row").schema.add("n", "long").add("form", "string")
    schema = schema.add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, bounds = joined(piece.column("text"))
                ends, first = unit_ends(data, bounds)
                index = Exceptions.of(data)
                raw = data.tobytes()
                n = np.diff(first)
                forms, outputs, cuts = [], [], np.zeros((piece.num_rows, 3), np.int64)
                for i, (key, low, high) in enumerate(
                    zip(piece.column("key").to_pylist(), bounds[:-1].tolist(), (bounds[1:] - 1).tolist(), strict=True)
                ):
                    text, (h1, h2, h3, h4), units = raw[low:high], draws(key, seed), int(n[i])
                    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
                        forms.append("plain")
                        outputs.append(text)
                        continue
                    places = [low + 0 if k == 0 else int(ends[first[i] + k - 1]) for k in sorted((h1 % (units + 1), h2 % (units + 1)))]
                    cuts[i] = low, *places
                    forms.append("spm" if h4 % 100 < spm else "psm")
                    a, b = (p - low for p in places)
                    outputs.append(rearranged(forms[-1], text[:a], text[a:b], text[b:]))
                chars = index.chars(cuts.ravel()).reshape(-1, 3)
                plain = np.array([f == "plain" for f in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("row"), pa.array(n, pa.int64()), pa.array(forms, pa.string()),
                        pa.array(chars[:, 1] - chars[:, 0], pa.int64(), mask=plain),
                        pa.array(chars[:, 2] - chars[:, 1], pa.int64(), mask=plain),
                        pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    names=["row", *added],
                )

    return rows.mapInArrow(run, schema).select("row.*", *added)


def rebuilt(rows: DataFrame) -> DataFrame:
    """``rows`` with ``restored``, the text rebuilt from output and form alone."""
    own = [c for c in rows.columns if c != "restored"]
    schema = rows.select(F.struct(*own).alias("row")).schema.add("restored", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column="output"):
                pairs = zip(piece.column("form").to_pylist(), piece.column("output").cast(pa.binary()).to_pylist(), strict=True)
                texts = pa.array([None if o is None else restored(f, o) for f, o in pairs], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([piece.column("row"), texts], names=["row", "restored"])

    return rows.select(F.struct(*own).alias("row"), "form", "output").mapInArrow(run, schema).select("row.*", "restored")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) per row of ``docs``."""
    rows = rebuilt(transformed(docs.select("doc_id", "text")).drop("text"))
    return rows.select(
        F.col("doc_id").cast("bigint"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )
