"""Secrets in texts, judged by how widely the corpus copies them.

Three patterns give the base spans, which always stay. Weaker candidates, long runs of mixed letters and digits, are
spans only if the corpus bears them out: the hash of every candidate value is counted over all documents, by distinct
repositories (documents) and distinct owners (sources). A value that both several owners and more than ``MOST_REPOS``
repositories have is a copied example; any other that looks random is live-looking: one copied page does not make
an example, and within a single owner a value is that owner's, however many repositories hold it. The counts are pre-aggregated per value, owner and
repository before anything is shuffled by value, so a value that stands in a large part of all documents is cheap.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.batches import joined, pieces
from stayline.session import durable

KINDS = ("assign", "access", "hex")
OWNED = "owned"  # the kind that corpus counts add
LEAST_OWNED = 20  # characters of such a candidate
MOST_OWNERS = 1  # a value of more owners and more repositories than these is a copied example
MOST_REPOS = 2
LEAST_ENTROPY = 3.0  # bits a character of a live-looking value
#: Fixed: what placeholder values say.
PLACEHOLDERS = re.compile(rb"(?i)example|sample|changeme|placeholder|dummy|xxxx|1234567|your")

_ASSIGN = re.compile(
    rb"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_IS_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
_IS_RUN = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-"))


def long_runs(inside: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of runs of at least ``least``."""
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    runs = edges.reshape(-1, 2)
    return runs[runs[:, 1] - runs[:, 0] >= least]


def looks_live(value: bytes) -> bool:
    size = len(value)
    bits = -sum(n / size * math.log2(n / size) for n in Counter(value).values())
    return bits >= LEAST_ENTROPY and not PLACEHOLDERS.search(value)


def base_spans(text: bytes, hex_runs: list[tuple[int, int]]) -> list[tuple[int, int, int, bytes]]:
    """(start, kind, end, value) in bytes, in order. ``hex_runs`` are those of 24 and more."""
    out = [(a, 2, b, text[a:b]) for a, b in hex_runs]
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    return sorted(out)


def is_mixed(value: bytes) -> bool:
    return bool(re.search(rb"[0-9]", value) and re.search(rb"[a-z]", value) and re.search(rb"[A-Z]", value))


def apart(runs: list[tuple[int, int]], base: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
    """Those of ``runs`` that no span of ``base`` overlaps. Of the spans that begin before a run ends, the one that ends last decides."""
    if not runs or not base:
        return runs
    starts = np.array([s for s, _, _, _ in base])
    furthest = np.maximum.accumulate([e for _, _, e, _ in base])
    both = np.array(runs)
    before = np.searchsorted(starts, both[:, 1])
    free = (before == 0) | (furthest[np.maximum(before - 1, 0)] <= both[:, 0])
    return [run for run, ok in zip(runs, free.tolist(), strict=True) if ok]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, OWNED)[kind]}:{start}:{end}" for start, kind, end in spans)


def candidate_spans(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """Per row of ``docs``: doc_id, repo, owner, the base counts, base_sha256 and ``found``, all candidates in order.

    A candidate is (start, kind, end, hash, live); places count characters.
    """
    schema = (
        "doc_id bigint, repo string, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string,"
        " found array<struct<start: bigint, kind: int, end: bigint, hash: string, live: boolean>>"
    )
    entry = pa.struct(
        [("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.string()), ("live", pa.bool_())]
    )

    def per_text(runs: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int]]]:
        out: list[list[tuple[int, int]]] = [[] for _ in bounds[1:]]
        for (a, b), i in zip(runs.tolist(), np.searchsorted(bounds, runs[:, 0], side="right") - 1, strict=True):
            out[i].append((a - int(bounds[i]), b - int(bounds[i])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, bounds = joined(piece.column("text"))
                hexes = per_text(long_runs(_IS_HEX[data], 24), bounds)
                longs = per_text(long_runs(_IS_RUN[data], LEAST_OWNED), bounds)
                raw, counts, digests, found = data.tobytes(), [], [], []
                for i in range(piece.num_rows):
                    text = raw[bounds[i] : bounds[i + 1] - 1]
                    base = base_spans(text, hexes[i])
                    more = [(a, 3, b, text[a:b]) for a, b in apart(longs[i], base) if is_mixed(text[a:b])]
                    spans = sorted(base + more)
                    if spans:
                        at = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
                        spans = [(int(at[a]), kind, int(at[b]), value) for a, kind, b, value in spans]
                    counts.append([sum(k == kind for _, k, _, _ in spans) for kind in range(3)])
                    digests.append(hashlib.sha256(written([s[:3] for s in spans if s[1] < 3]).encode()).hexdigest())
                    found.append(
                        [(a, k, b, hashlib.sha256(v).hexdigest(), looks_live(v)) for a, k, b, v in spans]
                    )
                columns = list(zip(*counts, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays(
                    [
                        *(piece.column(c) for c in ("doc_id", "repo", "owner")),
                        *(pa.array(c, pa.int64()) for c in columns),
                        pa.array(digests, pa.string()),
                        pa.array([[dict(zip(entry.names, x, strict=True)) for x in f] for f in found], pa.list_(entry)),
                    ],
                    names=["doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
                )

    return docs.select(
        F.col("doc_id").cast("bigint"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), "text"
    ).mapInArrow(run, schema)


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) of (hash, repo, owner). Null repositories are one, and so are null owners."""
    once = candidates.select("hash", "owner", "repo").distinct()
    by_owner = once.groupBy("hash", "owner").agg(F.count("*").alias("_n"))
    return by_owner.groupBy("hash").agg(F.sum("_n").alias("n_repos"), F.count("*").alias("n_owners"))


def secret_spans(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_example.

    ``spans`` has the base spans and the ``owned`` ones, by start, then kind. ``n_live`` and ``n_example`` part all
    base and added spans by the corpus counts: live-looking and not widely copied, or not. Needs doc_id, text and the two named
    columns; others are not read. A null or empty text has no spans. Repeated rows are judged alike and count as
    one repository if they share it. An empty table gives no rows.
    """
    found = durable(candidate_spans(docs, repo, owner).withColumn("_row", F.monotonically_increasing_id()))
    each = durable(found.select("_row", "repo", "owner", F.explode("found").alias("c")).select("_row", "repo", "owner", "c.*"))
    # Stored, so that the join below sees two plain tables and can split a value of very many documents.
    counts = durable(ownership(each))
    copied = (F.col("n_owners") > MOST_OWNERS) & (F.col("n_repos") > MOST_REPOS)
    judged = each.join(counts, "hash").withColumn("_live", F.col("live") & ~copied)
    kept = judged.where((F.col("kind") < 3) | F.col("_live"))
    per_row = kept.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("_spans"),
        F.sum((F.col("kind") == 3).cast("bigint")).alias("n_owned"),
        F.sum(F.col("_live").cast("bigint")).alias("n_live"),
        F.sum((~F.col("_live")).cast("bigint")).alias("n_example"),
    )
    names = F.array(*[F.lit(k) for k in (*KINDS, OWNED)])
    text = F.transform(
        "_spans", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    )
    zero = F.lit(0).cast("bigint")
    return found.drop("found", "repo", "owner").join(per_row, "_row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join(text, ","), F.lit("")).alias("spans"),
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("n_owned", "n_live", "n_example")],
    )
