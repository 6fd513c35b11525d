"""Detection with feedback by rounds over whole tables, so that a single run uses all tasks.

A scan's blips depend on the statistics, which leave out the blips of the scans before it. The first round takes nothing for a blip. Each further round works out the statistics without the blips that the
round before has found, and detects again; it ends when no statistics, or no runs of hot samples, change. The result is that of the fold (plans.coupled): of the scans whose blips a round has changed, the first one had the
right statistics, so every round settles at least one more scan of each sequence. Mostly blips change little from round to round, and few rounds are needed.

A round does only what the one before has changed: the statistics of rows of cells in which blips are others, the runs of hot samples in rows of cells whose statistics are others, and patches and
filters in scans whose runs are others. If no runs are, no blips are, and that is the end. Runs and patches of the rounds stay where they are, and are put together once, at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysweep.functions.stored import dropped, stored
from skysweep.operators import background as B
from skysweep.operators import patches as E
from skysweep.operators.patches import SCAN
from skysweep.plans import detect as D

PULSE = [*SCAN, "pulse"]


def blip_spans(runs: DataFrame, patches: DataFrame) -> DataFrame:
    """Where the blips are: spans (col, length) of each pulse that has any, in order."""
    blips = patches.where("is_blip").select(*SCAN, "patch_id")
    return runs.join(blips, [*SCAN, "patch_id"], "left_semi").groupBy(*PULSE).agg(F.array_sort(F.collect_list(F.struct("col", "length"))).alias("spans"))


def without_blips(pulses: DataFrame, spans: DataFrame) -> DataFrame:
    """pulses whose samples in a blip are null."""
    blank = "transform(samples, (x, i) -> if(exists(spans, s -> i >= s.col and i < s.col + s.length), null, x))"
    return pulses.join(spans, PULSE, "left").withColumn("samples", F.expr(f"if(spans is null, samples, {blank})")).drop("spans")


def _replaced(old: DataFrame, new: DataFrame, which: DataFrame, keys: list[str]) -> DataFrame:
    """old, which is deleted, with new in the place of the rows that which names by keys."""
    out = stored(old.join(which, keys, "left_anti").unionByName(new))
    dropped(old)
    return out


def _last(found: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Of each scan the rows of the last round that has detected in it: found has the scans and the rows of each round."""
    marked = [[x.withColumn("_round", F.lit(i)) for x in both] for i, both in enumerate(found)]
    scans, rows = (reduce(DataFrame.unionByName, x) for x in zip(*marked, strict=True))
    last = scans.groupBy(*SCAN).agg(F.max("_round").alias("_round"))
    return stored(rows.join(last, [*SCAN, "_round"], "left_semi").drop("_round"))


def detected_in_rounds(pulses: DataFrame, scans: DataFrame, params: D.Params, zones: DataFrame | None = None, clutter: DataFrame | None = None, stages: D.Stages | None = None) -> tuple[DataFrame, DataFrame, list[int]]:
    """Patches with is_blip and their runs, as plans.detect.detected gives them with feedback, and how many scans each round has scored again. Functions of the stages scores and classes may be given: they must
    give the same for the same scan and scores."""
    find = params.find
    whole = D.between_scores_and_runs(stages)  # such functions get whole scans
    row = F.expr(f"pulse div {find.cell_size}")
    plain = B.noise_filter(pulses, find.noise_cutoff) if find.noise_cutoff else pulses
    plain = stored((plain if whole else plain.select(*PULSE, "samples")).repartition(*SCAN, row))  # read in each round, by all tasks
    scans = stored(scans.select(*[F.col(c).cast("double") if kind == "void" else c for c, kind in scans.dtypes]))
    in_order, keys = B.sequences(scans)
    in_order = stored(in_order)
    cell_row, sequence = [*SCAN, "cell_row"], [*keys, "cell_row"]

    def statistics(rows: DataFrame) -> DataFrame:
        return B.ewma_cell_stats(rows, find.learn_scans, find.decay, keys, absent=True).select(*sequence, "scan_id", "mean", "dev")

    def hot_runs(some: DataFrame, by: DataFrame) -> DataFrame:
        return stored(D.hot_runs_of(some, scans, find, stages, by, number=False).withColumn("cell_row", row))

    cells = stored(B.cell_row_stats(plain, find.cell_size).join(in_order, SCAN))
    stats = stored(statistics(cells))
    rounds = [stats.select(*SCAN).distinct().count()]
    hot, others, spans = hot_runs(plain, stats), scans.select(*SCAN), None
    found: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    while True:
        # patches of the scans whose runs are others
        own = scans.join(others, SCAN, "left_semi") if found else scans
        runs = D.patched(E.numbered((hot.join(others, SCAN, "left_semi") if found else hot).drop("cell_row")), own, find)
        patches = stored(D.filtered(runs, own, params, zones, clutter))
        found.append((others, runs, patches))
        # statistics of the sequences of rows of cells whose blips are others
        new = stored(blip_spans(runs, patches))
        before = new.limit(0) if spans is None else spans.join(others, SCAN, "left_semi")
        both = new.withColumnRenamed("spans", "new").join(before, PULSE, "full").where("not (new <=> spans)")
        dirty = stored(both.select(*SCAN, row.alias("cell_row")).distinct().join(in_order, SCAN))
        spans = new if spans is None else _replaced(spans, new, others, SCAN)
        blank = without_blips(plain.withColumn("cell_row", row).join(dirty, cell_row, "left_semi").drop("cell_row"), spans)
        cells = _replaced(cells, B.cell_row_stats(blank, find.cell_size).join(in_order, SCAN), dirty, cell_row)
        again = stored(statistics(cells.join(dirty, sequence, "left_semi")))
        old = stats.withColumnsRenamed({"mean": "_mean", "dev": "_dev"})
        changed = stored(again.join(old, [*sequence, "scan_id"], "left").where("not (mean <=> _mean and dev <=> _dev)").drop("_mean", "_dev"))
        n = changed.select(*SCAN).distinct().count()
        if not n:
            break
        rounds.append(n)
        stats = _replaced(stats, again, dirty, sequence)
        # runs of the rows of cells whose statistics are others
        at = SCAN if whole else cell_row
        new = hot_runs(plain.join(changed, SCAN, "left_semi") if whole else plain, stats if whole else changed)
        one = hot.join(changed, at, "left_semi").unionByName(new).groupBy(*PULSE, "col", "length").count().where("count = 1")
        others = stored(one.select(*SCAN).distinct())
        if others.isEmpty():
            break
        hot = _replaced(hot, new, changed, at)
    out = [_last([(which, rows[i]) for which, *rows in found]) for i in (1, 0)] if len(found) > 1 else [patches, runs]
    dropped(plain, cells, stats, hot, spans)
    return *out, rounds
