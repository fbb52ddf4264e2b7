"""Subgroup search: conjunctions of category values in which a label is unusually frequent.

A subgroup's quality is its weighted relative accuracy: its share of all rows times how far its rate lies above the overall
rate. In whole numbers that is p * N - n * P over N^2, with n rows and p labelled ones of N and P in all. A part of a subgroup can
at best keep all its labelled rows and nothing else, which bounds the quality of everything below it by p * (N - P).

The lattice is searched level by level. Rows are summed up once into cells of equal values. A level's candidates are joined from
the last level's subgroups whose bound can still beat the best found so far, and are counted in one pass over the cells: each cell
lists its conjunctions of that length, those that are candidates are kept, and counts are added up before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions import numbers
from stayline.session import durable

WIDE = numbers.WIDE
PATH = "array<struct<place: int, value: string>>"


@dataclass(frozen=True)
class Level:
    """How many conjunctions of ``depth`` occur at all levels' open parts, and how many were counted."""

    depth: int
    candidates: int | None  # None: all of the first level
    counted: int


@dataclass
class Found:
    """``top`` has (depth, subgroup, n, n_labelled, quality, wracc)."""

    top: DataFrame
    levels: list[Level]


def cells(rows: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """One row per combination of values: ``_values`` in the order of ``columns``, ``_n`` and ``_p``. Rows without label are left out."""
    values = F.array(*[F.col(c).cast("string") for c in columns]).alias("_values")
    known = rows.where(F.col(label).isNotNull())
    return known.groupBy(values).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_p"))


def conjunctions(table: DataFrame, n_columns: int, depth: int) -> DataFrame:
    """(path, _n, _p): every conjunction of ``depth`` values that a cell has. A null value is no value."""
    def one(places: tuple[int, ...]) -> Column:
        path = F.array(*[F.struct(F.lit(i).alias("place"), F.col("_values")[i].alias("value")) for i in places])
        known = [F.col("_values")[i].isNotNull() for i in places]
        full = known[0]
        for k in known[1:]:
            full = full & k
        return F.when(full, path)

    paths = F.array(*[one(p) for p in combinations(range(n_columns), depth)])
    return table.select(F.explode(F.array_compact(paths)).alias("path"), "_n", "_p").withColumn("path", F.col("path").cast(PATH))


def joined_candidates(open_: DataFrame, depth: int) -> DataFrame:
    """(path) of ``depth`` values, all of whose parts of one value less are in ``open_`` (path)."""
    head = F.slice("path", 1, depth - 2) if depth > 2 else F.lit(None).cast(PATH)
    parts = open_.select(head.alias("head"), F.element_at("path", -1).alias("last"))
    left, right = parts.alias("l"), parts.alias("r")
    same = F.col("l.head").eqNullSafe(F.col("r.head")) & (F.col("l.last.place") < F.col("r.last.place"))
    paths = left.join(right, same).select(
        F.concat(F.coalesce("l.head", F.array().cast(PATH)), F.array("l.last", "r.last")).cast(PATH).alias("path")
    )
    for skipped in range(depth - 2):  # the two parts that lack one of the last values are open by the join
        part = F.array(*[F.col("path")[i] for i in range(depth) if i != skipped])
        paths = paths.withColumn("part", part).join(open_.withColumnRenamed("path", "part"), "part", "left_semi").select("path")
    return paths


def search(rows: DataFrame, columns: Sequence[str], label: str, top: int = 20, depth: int = 2) -> Found:
    """The ``top`` conjunctions of up to ``depth`` of ``columns`` with the highest quality for a 0/1 ``label``.

    Exact: what is pruned cannot be among them, not even by a tie. Ties go to fewer values, then to the smaller
    text. A null value belongs to no subgroup. A table without rows, or whose rows are all of one class, has subgroups of quality 0.
    """
    table = durable(cells(rows, columns, label))
    whole = table.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_p"), F.lit(0)).alias("p")).first()
    n_all, p_all = F.lit(whole.n).cast(WIDE), F.lit(whole.p).cast(WIDE)
    bound = F.col("n_labelled").cast(WIDE) * (n_all - p_all)
    names = F.array(*[F.lit(c) for c in columns])
    text = F.array_join(F.transform("path", lambda s: F.concat(names[s["place"]], F.lit("="), s["value"])), " & ")
    order = [F.col("quality").desc(), "depth", "subgroup"]

    best, open_, levels, least = None, None, [], None
    for k in range(1, min(depth, len(columns)) + 1):
        found, n_candidates = conjunctions(table, len(columns), k), None
        if k > 1:
            candidates = durable(joined_candidates(open_, k))
            n_candidates = candidates.count()
            if not n_candidates:
                break
            found = found.join(candidates, "path", "left_semi")
        counted = durable(
            found.groupBy("path").agg(F.sum("_n").alias("n"), F.sum("_p").alias("n_labelled"))
            .withColumn("quality", (F.col("n_labelled").cast(WIDE) * n_all - F.col("n").cast(WIDE) * p_all).cast(WIDE))
            .withColumns({"depth": F.lit(k), "subgroup": text})
        )
        levels.append(Level(k, n_candidates, counted.count()))
        own = counted.orderBy(*order).limit(top)
        best = durable((own if best is None else best.unionByName(own)).orderBy(*order).limit(top))
        ends = best.agg(F.count("*").alias("n"), F.min("quality").alias("least")).first()
        least = ends.least if ends.n == top else None
        open_ = counted.select("path", bound.alias("bound"))
        open_ = durable((open_ if least is None else open_.where(F.col("bound") >= F.lit(least))).select("path"))
    square = F.lit(float(whole.n)) * F.lit(float(whole.n))
    result = best.select("depth", "subgroup", "n", "n_labelled", "quality", F.try_divide(F.col("quality").cast("double"), square).alias("wracc"))
    return Found(result, levels)
