"""Resampling of tables of any size: draws are split over ranges of clusters or columns, so that each task draws its own part.

How often clusters are drawn is a multinomial count. It is drawn by halves:
of the draws that fall to a range of clusters a binomial share falls to its
first half, and so on down to single clusters. A random table with given
margins is drawn likewise: of the items of a range of columns, with their
composition by rows, a random subset is those of its first half. Each split
has a random stream of its own, by seed, run of draws and range, so that
every task that needs a split draws the same. What is never formed is a table
of all cells for all draws: a task holds one block of clusters or columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.relational import dense_numbers
from tallyloom.session import Scratch
from tallyloom.stats.contingency import draw_subsets

#: Clusters or columns of a block, draws of a run, and numbers (rows times draws) that a run's composition has at most.
BLOCK, RUN, WIDE = 256, 500, 4_000_000


def ranges_above(block: int, items: int) -> list[tuple[int, int, int, bool]]:
    """The splits from all ``items`` down to a block: begin, middle, end (in blocks) and whether the block is in the first half."""
    lo, hi, out = 0, -(-items // BLOCK), []
    while hi - lo > 1:
        mid = (lo + hi) // 2
        out.append((lo, mid, hi, block < mid))
        lo, hi = (lo, mid) if block < mid else (mid, hi)
    return out


def cluster_weights(clusters: int, block: int, seed: int, run: int, draws: int) -> np.ndarray:
    """How often each cluster of a block is drawn (rows), in each draw of a run, when as many are drawn with replacement as there are."""
    at, times = lambda b: min(b * BLOCK, clusters), np.full(draws, clusters)
    for lo, mid, hi, first in ranges_above(block, clusters):
        share = (at(mid) - at(lo)) / (at(hi) - at(lo))
        left = np.random.default_rng([seed, run, lo, hi]).binomial(times, share)
        times = left if first else times - left
    own = at(block + 1) - at(block)
    rng = np.random.default_rng([seed, run, block, block])
    out = np.empty((own, draws), dtype=np.int64)
    for k in range(own - 1):
        out[k] = rng.binomial(times, 1 / (own - k))
        times = times - out[k]
    out[own - 1] = times
    return out


def _units(blocks: DataFrame, runs: int) -> DataFrame:
    """Every block with every run of draws; a unit is a task's work and reads its block only."""
    return blocks.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).repartition("block", "run")


def bootstrap_tables(df: DataFrame, cluster: str, row: str, column: str, draws: int, seed: int) -> DataFrame:
    """draw, r, c and n: the filled cells of each draw's table, clusters drawn with replacement. Rows with nulls are left out."""
    scratch = Scratch(df.sparkSession, "bootstrap")
    cells = scratch.table(df.dropna(subset=[cluster, row, column]).groupBy(F.col(cluster).alias("k"), F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count("*").alias("n")), "cells")
    names = scratch.table(dense_numbers(cells, "k", "number"), "clusters")
    clusters = names.count()
    kinds = scratch.table(dense_numbers(cells.withColumn("rc", F.struct("r", "c")), "rc", "cell"), "kinds")
    met = cells.join(names, "k").join(kinds.select("rc.*", "cell"), ["r", "c"])
    blocks = met.groupBy(F.floor(F.col("number") / BLOCK).cast("int").alias("block")).agg(F.collect_list(F.struct((F.col("number") % BLOCK).cast("int").alias("at"), "cell", "n")).alias("cells"))

    def play(batches):
        for batch in batches:
            for block, cells_, run in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                size = min(RUN, draws - run * RUN)
                weights = cluster_weights(clusters, block, seed, run, size)
                at, cell, n = (np.array([x[f] for x in cells_], dtype=np.int64) for f in ("at", "cell", "n"))
                order = np.argsort(cell, kind="stable")
                at, cell, n = at[order], cell[order], n[order]
                first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
                # A piece of the cells at a time, whole cells each.
                step = max(1, WIDE // size)
                for lo in range(0, len(first), step):
                    ends = np.append(first[lo : lo + step], first[lo + step] if lo + step < len(first) else len(cell))
                    part = slice(ends[0], ends[-1])
                    sums = np.add.reduceat(weights[at[part]] * n[part, None], ends[:-1] - ends[0], axis=0)
                    k, d = np.nonzero(sums)
                    yield pa.RecordBatch.from_arrays([pa.array(run * RUN + d, pa.int64()), pa.array(cell[ends[:-1]][k], pa.int64()), pa.array(sums[k, d], pa.int64())], names=["draw", "cell", "n"])

    drawn = _units(blocks, -(-draws // RUN)).select("block", "cells", "run").mapInArrow(play, "draw long, cell long, n long")
    return drawn.groupBy("draw", "cell").agg(F.sum("n").alias("n")).join(kinds.select("rc.*", "cell"), "cell").select("draw", "r", "c", "n")


def cramers_v_by(cells: DataFrame, by: str) -> DataFrame:
    """Cramér's V of each table of filled cells (``by``, r, c, n); null where one side has one level only."""
    rows, columns = (cells.groupBy(by, s).agg(F.sum("n").cast("double").alias(f"n_{s}")) for s in ("r", "c"))
    ratio = F.col("n").cast("double") * F.col("n") / (F.col("n_r") * F.col("n_c"))
    sums = cells.join(rows, [by, "r"]).join(columns, [by, "c"]).groupBy(by).agg(F.sum(ratio).alias("q"))
    levels = rows.groupBy(by).agg(F.count("*").alias("rows")).join(columns.groupBy(by).agg(F.count("*").alias("columns")), by)
    least = F.least("rows", "columns")
    return sums.join(levels, by).select(by, F.when(least > 1, F.sqrt(F.greatest(F.col("q") - 1, F.lit(0.0)) / (least - 1))).alias("v"))


def bootstrap_cramers_v(df: DataFrame, cluster: str, row: str, column: str, draws: int = 10_000, seed: int = 20_260_911, degenerate: str = "skip") -> dict:
    """Cramér's V and its percentile interval when clusters are drawn with replacement; degenerate draws are skipped or count as 0. The driver holds a number a draw."""
    cells = df.dropna(subset=[cluster, row, column]).groupBy(F.lit(0).alias("all"), F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count("*").alias("n"))
    whole = cramers_v_by(Scratch(df.sparkSession, "bootstrap").table(cells, "whole"), "all").first()
    if whole is None:
        return {"cramers_v": None, "low": None, "high": None, "draws": 0}
    tables = Scratch(df.sparkSession, "bootstrap").table(bootstrap_tables(df, cluster, row, column, draws, seed), "tables")
    values = [r["v"] for r in cramers_v_by(tables, "draw").collect()]
    values = [v or 0.0 for v in values] if degenerate == "zero" else [v for v in values if v is not None]
    low, high = (float(x) for x in np.quantile(values, [0.025, 0.975])) if values else (None, None)
    return {"cramers_v": whole["v"], "low": low, "high": high, "draws": len(values)}


#: Scores a block's tables: columns' numbers and counts (draws, columns, rows) to sums (draws, statistics).
Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


def composition(totals: np.ndarray, path: list[tuple[int, int, int, bool]], sizes: list[int], columns: np.ndarray, block: int, seed: int, run: int, draws: int) -> np.ndarray:
    """A block of random tables with the rows' ``totals``: counts (draws, columns, rows). ``sizes``: items of the first half at each split of ``path``; ``columns``: the block's column totals."""
    now = np.repeat(totals[None, :], draws, axis=0)
    for (lo, _, hi, first), size in zip(path, sizes, strict=True):
        left = draw_subsets(np.random.default_rng([seed, run, lo, hi]), now, np.full(draws, size))
        now = left if first else now - left
    rng = np.random.default_rng([seed, run, block, block])
    out = np.empty((draws, len(columns), len(totals)), dtype=np.int64)
    for k, size in enumerate(columns[:-1]):
        out[:, k] = draw_subsets(rng, now, np.full(draws, size))
        now = now - out[:, k]
    out[:, -1] = now
    return out


def permuted_sums(cells: DataFrame, score: Score, n_rows: int, draws: int, seed: int) -> tuple[np.ndarray, DataFrame]:
    """Statistics that add up over columns, of the table itself and of random tables with its margins: values of the table, and a frame of draw and s0, s1, ....

    ``cells``: r and c (numbers from 0, rows the shorter side) and n.
    """
    scratch = Scratch(cells.sparkSession, "permuted")
    cells = scratch.table(cells, "cells")
    totals = np.zeros(n_rows, dtype=np.int64)
    for r, n in cells.groupBy("r").agg(F.sum("n")).collect():
        totals[r] = n
    n_columns = (cells.agg(F.max("c")).first()[0] or 0) + 1
    size = max(1, min(RUN, WIDE // max(1, n_rows * BLOCK)))
    block = F.floor(F.col("c") / BLOCK).cast("int").alias("block")
    at = (F.col("c") % BLOCK).cast("int").alias("at")
    held = scratch.table(cells.groupBy(block).agg(F.sum("n").alias("items"), F.collect_list(F.struct(at, F.col("r").cast("int").alias("r"), "n")).alias("cells")), "blocks")
    # Items before each block, to have those of any range: one number a block of columns, packed by a window over blocks only.
    items = {r[0]: r[1] for r in held.select("block", "items").collect()}
    n_blocks = -(-n_columns // BLOCK)
    before = np.concatenate(([0], np.cumsum([items.get(b, 0) for b in range(n_blocks)])))
    known = cells.sparkSession.sparkContext.broadcast((totals, before))

    def table_of(found, columns):
        out = np.zeros((1, columns, n_rows), dtype=np.int64)
        for x in found:
            out[0, x["at"], x["r"]] = x["n"]
        return out

    def told(draw, sums):
        return pa.RecordBatch.from_arrays([pa.array(draw, pa.int64()), *(pa.array(s, pa.int64()) for s in sums.astype(np.int64).T)], names=["draw", *(f"s{k}" for k in range(sums.shape[1]))])

    def play(batches):
        totals_, before_ = known.value
        for batch in batches:
            for b, found, run in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                columns = min(BLOCK, n_columns - b * BLOCK)
                numbers, own = np.arange(columns) + b * BLOCK, table_of(found, columns)
                if run < 0:
                    yield told([-1], score(numbers, own))
                    continue
                now = min(size, draws - run * size)
                path = ranges_above(b, n_columns)
                sizes = [int(before_[mid] - before_[lo]) for lo, mid, _, _ in path]
                made = composition(totals_, path, sizes, own[0].sum(1), b, seed, run, now)
                yield told(np.arange(now) + run * size, score(numbers, made))

    wide = score(np.zeros(0, dtype=np.int64), np.zeros((1, 0, n_rows), dtype=np.int64)).shape[1]
    schema = "draw long, " + ", ".join(f"s{k} long" for k in range(wide))
    runs = -(-draws // size)
    units = held.select("block", "cells", F.explode(F.sequence(F.lit(-1), F.lit(runs - 1))).alias("run")).repartition("block", "run")
    sums = units.mapInArrow(play, schema).groupBy("draw").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(wide)])
    sums = scratch.table(sums, "sums")
    own = sums.filter("draw = -1").first()
    return np.array([own[f"s{k}"] for k in range(wide)]) if own else np.zeros(wide, np.int64), sums.filter("draw >= 0")


def numbered_cells(df: DataFrame, row: str, column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts by r, c (numbers from 0) and the tables of both sides' values with their numbers; nulls are left out."""
    scratch = Scratch(df.sparkSession, "numbered")
    counts = scratch.table(df.dropna(subset=[row, column]).groupBy(F.col(row).alias("__r"), F.col(column).alias("__c")).agg(F.count("*").alias("n")), "counts")
    rows, columns = (scratch.table(dense_numbers(counts, s, s[-1]), s) for s in ("__r", "__c"))
    return counts.join(rows, "__r").join(columns, "__c").select("r", "c", "n"), rows.select(F.col("__r").alias(row), "r"), columns.select(F.col("__c").alias(column), "c")


def _tail(sums: DataFrame, value: Column, observed: int) -> int:
    return sums.filter(value >= observed).count()


def richness_permutation(df: DataFrame, arm: str, label: str, draws: int = 10_000, seed: int = 20_260_911) -> dict:
    """Distinct labels of two arms, their difference and its two-sided p when arms are shuffled; for any number of labels."""
    cells, arms, _ = numbered_cells(df, arm, label)
    if arms.count() != 2:
        raise ValueError("two arms are compared")
    own, sums = permuted_sums(cells, lambda _, tables: (tables > 0).sum(1), 2, draws, seed)
    observed = abs(int(own[0] - own[1]))
    hits = _tail(sums, F.abs(F.col("s0") - F.col("s1")), observed)
    return {"first": int(own[0]), "second": int(own[1]), "difference": int(own[0] - own[1]), "p": (hits + 1) / (draws + 1)}


def alignment_permutation(df: DataFrame, group: str, label: str, expected: DataFrame, draws: int = 20_000, seed: int = 20_260_921) -> dict:
    """Share of rows whose label is expected for their group (``expected``: pairs of both), against labels dealt at random; for any number of labels.

    The groups are the side that a task holds whole, with the labels that each expects.
    """
    cells, groups, labels = numbered_cells(df, group, label)
    n_groups = groups.count()
    pairs = expected.dropDuplicates([group, label]).join(groups, group).join(labels, label).select("r", "c")
    hits = {}
    for r, c in pairs.collect():
        hits.setdefault(c, []).append(r)
    known = df.sparkSession.sparkContext.broadcast(hits)

    def score(numbers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        out = np.zeros((len(tables), 1), dtype=np.int64)
        for k, c in enumerate(numbers.tolist()):
            if c in known.value:
                out[:, 0] += tables[:, k, known.value[c]].sum(1)
        return out

    total = cells.agg(F.sum("n")).first()[0] or 0
    own, sums = permuted_sums(cells, score, n_groups, draws, seed)
    counted = sums.groupBy("s0").agg(F.count("*").alias("n")).orderBy("s0").collect()
    values, n = np.array([r[0] for r in counted], dtype=np.int64), np.array([r[1] for r in counted], dtype=np.int64)
    low, high = (weighted_quantile(values, n, q) / total for q in (0.025, 0.975))
    return {"observed": float(own[0] / total), "expected": float((values * n).sum() / n.sum() / total), "low": low, "high": high, "p": (int(n[values >= own[0]].sum()) + 1) / (draws + 1)}


def weighted_quantile(values: np.ndarray, n: np.ndarray, share: float) -> float:
    """The interpolated quantile of sorted values that each came ``n`` times."""
    upto, at = np.cumsum(n), (n.sum() - 1) * share
    lo, hi = values[np.searchsorted(upto, np.floor(at), side="right")], values[np.searchsorted(upto, np.ceil(at), side="right")]
    return float(lo + (hi - lo) * (at - np.floor(at)))
