"""Quality of documents from a linear-chain conditional random field over their lines.

Each line has one of two states, bad or good. Its features are simple measures of the line and of the lines before and
behind it; neighbouring states are tied by transition weights. Training gives every line of a labelled document the
document's label and maximises the penalised likelihood of the state sequences. To score a document, forward-backward
gives each line's probability of being good; their mean, weighted by the lines' lengths, is the document's quality,
and a logistic curve fitted on the training sample turns it into a probability of the label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm import words
from stayline.llm.batches import joined, pieces
from stayline.llm.language import held_out

FEATURES = 16  # of a line itself
SAMPLE_DOCS = 2_000  # labelled documents the model is fitted on, lowest hash first
SAMPLE_LINES = 300  # lines of each that the fit uses; scoring uses all lines
PENALTY = 1e-3
STEPS = 150
RATE = 0.1

_c = np.arange(256)
_CLASSES = np.stack(
    [
        (_c >= 0x61) & (_c <= 0x7A),  # lower case
        (_c >= 0x41) & (_c <= 0x5A),  # upper case
        (_c >= 0x30) & (_c <= 0x39),  # digits
        _c >= 0x80,  # beyond ASCII
        (_c == 0x20) | (_c == 0x09),  # blanks
        np.isin(_c, list(b".,;:?'\"")),  # ordinary marks
        np.isin(_c, list(b"!|")),
        np.isin(_c, list(b"#$%&*@^~_=+<>\\{}[]/")),
    ],
    axis=1,
)
CLASSES = _CLASSES.shape[1] + 1  # the last: none of these
_CLASS = np.where(_CLASSES.any(axis=1), _CLASSES.argmax(axis=1), CLASSES - 1).astype(np.int32)


def line_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of the texts, the lines' lengths, and where each text's lines begin (and the last end).

    Texts end with a line feed each, as ``joined`` makes them; a text without line feeds is one line, an empty text one
    empty line.
    """
    ends = np.flatnonzero(data == 0x0A)
    starts = np.r_[0, ends[:-1] + 1]
    first = np.searchsorted(starts, bounds)
    lengths = ends - starts
    n = len(starts)
    if not n:
        return np.zeros((0, 3 * FEATURES + 1), np.float32), lengths, first
    line_of_byte = np.repeat(np.arange(n, dtype=np.int32), lengths + 1)
    counts = np.bincount(line_of_byte * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    counts = counts[:, : CLASSES - 1].astype(np.float32)
    share = counts / np.maximum(lengths, 1)[:, None]
    word_from, word_to = words.word_bounds(data)
    hashes = words.word_hashes(data, word_from, word_to)
    at = np.searchsorted(word_from, starts)
    n_words = np.diff(np.r_[at, len(word_from)])
    line_of_word = np.repeat(np.arange(n), n_words)
    # Words that occurred before in the same line: those beyond its distinct ones (by 40 bits of their hashes).
    keys = np.sort((line_of_word.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    distinct = keys[np.r_[True, keys[1:] != keys[:-1]][: len(keys)]] >> np.uint64(40)
    again = n_words - np.bincount(distinct.astype(np.int64), minlength=n)
    # Lines that occurred before in the same text: their words' hashes, mixed with the place, add up to the same.
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(words.mix(hashes + (np.arange(len(hashes)) - at[line_of_word]).astype(np.uint64)))]
    folded = total[np.r_[at[1:], len(hashes)]] - total[at]
    text_of_line = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    by_text = np.lexsort((np.arange(n), folded, text_of_line))
    copy = np.zeros(n, np.float32)
    copy[by_text] = np.r_[False, (np.diff(text_of_line[by_text]) == 0) & (folded[by_text][1:] == folded[by_text][:-1])]
    letters = counts[:, 0] + counts[:, 1] + counts[:, 3]
    own = np.column_stack(
        [
            share,
            np.sqrt(share[:, [1, 6, 7]]),
            np.log1p(lengths) / 5,
            letters / np.maximum(n_words, 1) / 10,
            again / np.maximum(n_words, 1),
            copy,
            lengths == 0,
        ]
    ).astype(np.float32)
    starts_text, ends_text = np.zeros(n, bool), np.zeros(n, bool)
    starts_text[first[:-1]], ends_text[first[1:] - 1] = True, True
    before = np.where(starts_text[:, None], 0, np.r_[own[:1], own[:-1]])
    behind = np.where(ends_text[:, None], 0, np.r_[own[1:], own[-1:]])
    return np.column_stack([own, before, behind, np.ones(n, np.float32)]), lengths, first


PIECE_BYTES = 4 << 20  # one step of the recursions serves many texts


def steps_of(first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each position in the texts, the texts that are that long (longest first) and their lines there."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    alive = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    return [(order[:a], first[:-1][order[:a]] + t) for t, a in enumerate(alive)]


def forward_backward(scores: np.ndarray, ties: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of state 1, and the expected number of transitions between the states (2 x 2).

    ``scores`` is state 1's score above state 0's; ``ties`` the transitions' scores. All texts advance together.
    """
    n, texts = len(scores), len(first) - 1
    unary = np.column_stack([np.zeros(n), scores])
    move = np.exp(ties - ties.max())
    emit = np.exp(unary - unary.max(axis=1, keepdims=True))
    ahead, back = np.empty((n, 2)), np.empty((n, 2))
    steps, state = steps_of(first), np.zeros((texts, 2))
    for t, (who, lines) in enumerate(steps):
        now = emit[lines] if t == 0 else (state[who] @ move) * emit[lines]
        state[who] = ahead[lines] = now / now.sum(axis=1, keepdims=True)
    expected = np.zeros((2, 2))
    state = np.ones((texts, 2))
    for t in range(len(steps) - 1, -1, -1):
        who, lines = steps[t]
        back[lines] = state[who]
        if t:
            now = emit[lines] * state[who]
            pair = ahead[lines - 1][:, :, None] * move * now[:, None, :]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            now = now @ move.T
            state[who] = now / now.sum(axis=1, keepdims=True)
    both = ahead * back
    return both[:, 1] / both.sum(axis=1), expected


@dataclass(frozen=True)
class Field:
    """A fitted random field and the curve from mean probability to score."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    ties: np.ndarray
    slope: float
    shift: float

    def line_probabilities(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        scores = ((features - self.centre) / self.spread) @ self.weights
        return forward_backward(scores, self.ties, first)[0]

    def scores(self, features: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-(self.slope * log_odds(quality(self.line_probabilities(features, first), lengths, first)) + self.shift)))


def quality(probabilities: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean probability of a text's lines, weighted by their lengths (at least 1)."""
    weight = np.maximum(lengths, 1)
    return np.add.reduceat(probabilities * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Adam:
    def __init__(self, size: int, rate: float = RATE) -> None:
        self.mean, self.square, self.rate, self.t = np.zeros(size), np.zeros(size), rate, 0

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.mean = 0.9 * self.mean + 0.1 * gradient
        self.square = 0.999 * self.square + 0.001 * gradient**2
        return self.rate * (self.mean / (1 - 0.9**self.t)) / (np.sqrt(self.square / (1 - 0.999**self.t)) + 1e-8)


def fit(features: np.ndarray, lengths: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Field:
    """Fits the field to texts whose lines all have the text's label (0 or 1)."""
    centre, spread = features.mean(axis=0), features.std(axis=0)
    centre[-1], spread = 0, np.where(spread > 1e-6, spread, 1)
    x = ((features - centre) / spread).astype(np.float64)
    sizes = np.diff(first)
    states = np.repeat(labels, sizes).astype(float)
    observed = np.diag([(sizes - 1)[labels == 0].sum(), (sizes - 1)[labels == 1].sum()]).astype(float)
    theta, ways, n = np.zeros(x.shape[1] + 4), Adam(x.shape[1] + 4), len(x)
    for _ in range(STEPS):
        p, expected = forward_backward(x @ theta[:-4], theta[-4:].reshape(2, 2), first)
        gradient = np.r_[x.T @ (states - p), (observed - expected).ravel()] / n - PENALTY * theta
        theta = theta + ways.step(gradient)
    weights, ties = theta[:-4], theta[-4:].reshape(2, 2)
    odds = log_odds(quality(forward_backward(x @ weights, ties, first)[0], lengths, first))
    curve, ways = np.array([0.5, 0.0]), Adam(2)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(curve[0] * odds + curve[1])))
        curve = curve + ways.step(np.array([((labels - p) * odds).mean(), (labels - p).mean()]) - PENALTY * curve)
    return Field(centre, spread, weights, ties, float(curve[0]), float(curve[1]))


def learn(docs: DataFrame, labels: DataFrame) -> Field | None:
    """The field from documents with a label, held-out ones left out; None if no label is left.

    The driver receives the line features of ``SAMPLE_DOCS`` documents, ``SAMPLE_LINES`` lines each, at most. A document
    labelled twice has its smallest label; one that occurs twice is sampled twice at most.
    """
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(SAMPLE_DOCS)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, PIECE_BYTES):
                features, lengths, first = line_features(*joined(piece.column("text")))
                rows = [
                    (d, q, lengths[a : min(b, a + SAMPLE_LINES)].tolist(), features[a : min(b, a + SAMPLE_LINES)].tobytes())
                    for d, q, a, b in zip(
                        piece.column("doc_id").to_pylist(), piece.column("quality").to_pylist(), first[:-1], first[1:], strict=True
                    )
                ]
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["doc_id", "quality", "lengths", "features"],
                )

    # The chosen ids are SAMPLE_DOCS rows at most.
    sample = docs.select(F.col("doc_id").cast("bigint"), "text").join(
        F.broadcast(chosen.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int"))), "doc_id"
    )
    schema = "doc_id bigint, quality int, lengths array<bigint>, features binary"
    rows = sample.mapInArrow(run, schema).orderBy(F.md5(F.col("doc_id").cast("string")), "features").limit(2 * SAMPLE_DOCS).collect()
    if not rows:
        return None
    lengths = [np.array(r["lengths"], np.int64) for r in rows]
    features = np.concatenate([np.frombuffer(r["features"], np.float32) for r in rows]).reshape(-1, 3 * FEATURES + 1)
    first = np.r_[0, np.cumsum([len(x) for x in lengths])]
    return fit(features, np.concatenate(lengths), first, np.array([r["quality"] for r in rows]))


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on). Without a field every score is 0.5.

    Reads text alone; other columns are kept, clashing ones replaced. A null or empty text is one empty line. Equal texts get equal
    scores. An empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*own).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, PIECE_BYTES):
                found = line_features(*joined(piece.column("text")))
                values = field.scores(*found) if field else np.full(piece.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in own), pa.array(values, pa.float64())], names=[*own, "score"]
                )

    return docs.select(*own).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
