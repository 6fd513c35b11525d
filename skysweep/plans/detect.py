"""The detection job: pulses and scans to patches and blips, as one lazy plan in the uncoupled mode."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysweep.functions.geometry import pulse_table
from skysweep.functions.stored import stored
from skysweep.operators import background as B
from skysweep.operators import filters as Z
from skysweep.operators import patches as E
from skysweep.operators import stats as S
from skysweep.operators import tracking as G


@dataclass(frozen=True)
class FindParams:
    """Learning and scoring. exclude_blips: feedback, statistics leave blips out; in_rounds: by rounds over whole tables (plans.rounds), for few long runs, instead of a fold for each run."""

    cell_size: int = 4
    learn_scans: int = 15
    decay: float = 0.95
    noise_cutoff: int = 0
    hot_score: float = 2.5
    low_score: float = -128.0
    exclude_blips: bool = True
    in_rounds: bool = False
    diagonal: bool = False


@dataclass(frozen=True)
class BlipParams:
    """Filters of patches: inclusive ranges (a negative maximum is none) and a predicate."""

    filtering: bool = True
    samples: tuple[float, float] = (30, 5000)
    area: tuple[float, float] = (200.0, 10000.0)
    angular: tuple[float, float] = (2, -1)
    radial: tuple[float, float] = (2, -1)
    expression: str | None = None
    area_weighting: bool = False


@dataclass(frozen=True)
class TrackParams:
    """Tracking: model (mfc or nn), speed limit, the least number of blips of a track, and the gates of nn. max_dist: the distance of no gain; None for the field of view. slices:
    scans a slice and scans of warm-up, for runs that are too long for one task each."""

    model: str = "mfc"
    max_speed_kmh: float = 100.0
    min_blips: int = 4
    max_dist: float | None = None
    stale_s: float = 10.0
    max_change_percent: float = 150.0
    max_turn_rate: float = 20.0
    slices: tuple[int, int] | None = None


@dataclass(frozen=True)
class MfcParams:
    """The multi-frame tracker: frames looked back on, weight of direction against nearness, penalty of a gap, least gain."""

    frames: int = 2
    alpha: float = 0.5
    epsilon: float = 1e-3
    min_gain: float = 0.9090909090909


@dataclass(frozen=True)
class AntennaParams:
    """Scan fields that the antenna sets (name to value) where a scan has none; those in override are set in any case."""

    settings: dict[str, float] = field(default_factory=dict)
    override: tuple[str, ...] = ()


@dataclass(frozen=True)
class DeclutterParams:
    """Dropping of blips on clutter, if there is a clutter map: cutoff, in mean hits of a scan."""

    enabled: bool = True
    cutoff: float = 0.003


@dataclass(frozen=True)
class ZoneParams:
    """Zone filters, if there is a zone table: predicates by zone_ord beside its ranges."""

    enabled: bool = True
    expressions: dict[int, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Params:
    find: FindParams = field(default_factory=FindParams)
    blip: BlipParams = field(default_factory=BlipParams)
    track: TrackParams = field(default_factory=TrackParams)
    mfc: MfcParams = field(default_factory=MfcParams)
    antenna: AntennaParams = field(default_factory=AntennaParams)
    declutter: DeclutterParams = field(default_factory=DeclutterParams)
    zones: ZoneParams = field(default_factory=ZoneParams)

    @classmethod
    def of(cls, groups: dict[str, dict]) -> Params:
        """From {"find": {...}, "blip": {...}, ...}; unknown groups and names are rejected."""
        kinds = {f.name: f.default_factory for f in fields(cls)}
        for group, values in groups.items():
            if group not in kinds:
                raise ValueError(f"unknown parameter group: {group}")
            if wrong := set(values) - {f.name for f in fields(kinds[group])}:
                raise ValueError(f"unknown parameters of {group}: {sorted(wrong)}")
        return cls(**{k: kinds[k](**v) for k, v in groups.items()})


#: The stages that functions may stand between: what each gets and gives back. pulses: samples arrays, before anything else (scans beside them are not changed); scores and classes: pulses with scores, and with
#: classes, arrays beside samples; patches: patches with is_blip, after the filters.
STAGES = ("pulses", "scores", "classes", "patches")
Stages = dict[str, list[Callable[[DataFrame], DataFrame]]]


def staged(frame: DataFrame, stages: Stages | None, stage: str) -> DataFrame:
    """frame after the functions of a stage, in order. Each must keep the columns and their types; rows it may add and remove."""
    for f in (stages or {}).get(stage, []):
        out = f(frame)
        kinds = dict(out.dtypes)
        if lost := [c for c, kind in frame.dtypes if kinds.get(c) != kind]:
            raise ValueError(f"a function of the stage {stage} changes or drops columns: {lost}")
        frame = out.select(*frame.columns)
    return frame


def scored_samples(pulses: DataFrame, params: FindParams, scans: DataFrame | None = None) -> DataFrame:
    """Samples with scores by the statistics valid before their scan."""
    return B.explode_scored(B.score_samples(_denoised(pulses, params), cell_stats(pulses, params, scans), params.cell_size))


def _denoised(pulses: DataFrame, params: FindParams) -> DataFrame:
    return B.noise_filter(pulses, params.noise_cutoff) if params.noise_cutoff else pulses


def cell_stats(pulses: DataFrame, params: FindParams, scans: DataFrame | None = None) -> DataFrame:
    """Statistics of cells valid before each scan: source_id, run_id, scan_id, cell_row, mean, dev. With scans, each sequence (restart, angle class) learns for itself."""
    rows = B.cell_row_stats(_denoised(pulses, params), params.cell_size)
    keys = B.RUN
    if scans is not None:
        in_order, keys = B.sequences(scans)
        rows = rows.join(in_order, E.SCAN)  # rows of cells, not samples
    stats = B.ewma_cell_stats(rows, params.learn_scans, params.decay, keys)
    return stored(stats.select(*E.SCAN, "cell_row", "mean", "dev"))  # the only ordered step: one row per row of cells and scan


def hot_runs_of(pulses: DataFrame, scans: DataFrame, params: FindParams, stages: Stages | None, stats: DataFrame, number: bool = True) -> DataFrame:
    """Runs of hot samples with values. Samples stay in arrays: only hot runs become rows."""
    if between_scores_and_runs(stages):
        scored = staged(B.score_samples(_denoised(pulses, params), stats, params.cell_size), stages, "scores")
        return E.classified_runs(staged(B.classify_pulses(scored, params.hot_score, params.low_score), stages, "classes"), scans, number)
    return E.scored_runs(B.with_cell_stats(_denoised(pulses, params), stats, params.cell_size), scans, params.cell_size, params.hot_score, params.low_score, number)


def between_scores_and_runs(stages: Stages | None) -> bool:
    """Whether functions of the user get scores or classes."""
    return any((stages or {}).get(x) for x in ("scores", "classes"))


def patched(runs: DataFrame, scans: DataFrame, params: FindParams) -> DataFrame:
    """Numbered runs with patch_id, of patches of more than one sample."""
    runs = stored(runs)  # read again for adjacency, samples and perimeter; a small part of the samples
    return stored(E.drop_singletons(E.find_patches(runs, E.run_adjacency(runs, scans, params.diagonal))))


def runs_of(pulses: DataFrame, scans: DataFrame, params: FindParams, stages: Stages | None = None) -> DataFrame:
    """Runs with patch_id and values, of patches of more than one sample."""
    return patched(hot_runs_of(pulses, scans, params, stages, cell_stats(pulses, params, scans)), scans, params)


def measured(runs: DataFrame, scans: DataFrame, area_weighting: bool = False) -> DataFrame:
    """Statistics of the patches of runs (with values)."""
    geometry = pulse_table(scans).select(*E.SCAN, "pulse", "azi", "elev")
    stats = S.patch_stats(E.run_values(runs), geometry, scans, area_weighting)
    edges = S.perimeter(runs, E.run_adjacency(runs, scans), geometry, scans)  # touching runs are always of one patch
    return stats.join(edges, S.PATCH)


def refilter(patches: DataFrame, params: BlipParams) -> DataFrame:
    """is_blip by the filters alone, on stored patches: nothing is detected again."""
    patches = Z.unfilter(patches)
    if not params.filtering:
        return patches
    patches = Z.filter_range(patches, samples=params.samples, area=params.area, angular=params.angular, radial=params.radial)
    return Z.filter_expr(patches, params.expression) if params.expression else patches


def detected(pulses: DataFrame, scans: DataFrame, params: Params, zones: DataFrame | None = None, clutter: DataFrame | None = None, stages: Stages | None = None) -> tuple[DataFrame, DataFrame]:
    """Patches with is_blip, and their runs. With exclude_blips, statistics leave blips out, which ties each scan to those before it (plans.coupled); the filters are then those of
    the fold, in both modes the whole chain: ranges, expression, zones, clutter. stages: functions by the name of their stage (STAGES); scores and classes can't be changed with feedback by folds, where they live inside the fold."""
    if wrong := set(stages or {}) - set(STAGES):
        raise ValueError(f"unknown stages: {sorted(wrong)}")
    pulses = staged(pulses, stages, "pulses")
    if params.find.exclude_blips and params.find.in_rounds:
        from skysweep.plans.rounds import detected_in_rounds

        patches, runs, _ = detected_in_rounds(pulses, scans, params, zones, clutter, stages)
        return staged(patches, stages, "patches"), runs
    if params.find.exclude_blips:
        from skysweep.plans.coupled import coupled_runs

        if between_scores_and_runs(stages):
            raise ValueError("scores and classes are not tables with feedback by folds: set in_rounds, or exclude_blips to false")
        runs = stored(coupled_runs(pulses, scans, params, zones, clutter))  # read again for samples, adjacency and perimeter
        flags = runs.groupBy(*S.PATCH).agg(F.first("is_blip").alias("is_blip"))
        return staged(measured(runs, scans, params.blip.area_weighting).join(flags, S.PATCH), stages, "patches"), runs
    runs = runs_of(pulses, scans, params.find, stages)
    return staged(filtered(runs, scans, params, zones, clutter), stages, "patches"), runs


def filtered(runs: DataFrame, scans: DataFrame, params: Params, zones: DataFrame | None = None, clutter: DataFrame | None = None) -> DataFrame:
    """The patches of runs with is_blip by the whole chain of filters."""
    patches = refilter(measured(runs, scans, params.blip.area_weighting), params.blip)
    if zones is not None and params.zones.enabled:
        patches = Z.filter_zones(patches, zones, params.zones.expressions).drop("zone_ord")
    if clutter is not None and params.declutter.enabled:
        patches = Z.filter_clutter(patches, E.patch_samples(runs), scans, clutter, params.declutter.cutoff)
    return patches


def detect(pulses: DataFrame, scans: DataFrame, params: Params | None = None, zones: DataFrame | None = None, clutter: DataFrame | None = None, stages: Stages | None = None) -> DataFrame:
    """Patches with is_blip."""
    return detected(pulses, scans, params or Params(), zones, clutter, stages)[0]


def with_antenna(scans: DataFrame, params: AntennaParams) -> DataFrame:
    """Scans with the antenna's settings, the same for all sources (sources.scans.apply_antenna takes a table of antennas)."""
    for name, value in params.settings.items():
        own = F.lit(float(value))
        scans = scans.withColumn(name, own if name in params.override or name not in scans.columns else F.coalesce(F.col(name), own))
    return scans


def track_blips(blips: DataFrame, scans: DataFrame, params: Params) -> DataFrame:
    """Points of the tracks of blips (blip_id, t, x, y, z, area, int), without the short ones."""
    track, mfc = params.track, params.mfc
    if track.model == "nn":
        points = G.track_nn(blips, scans, track.slices, max_speed_kmh=track.max_speed_kmh, max_change_percent=track.max_change_percent, max_turn_rate=track.max_turn_rate, stale_s=track.stale_s)
    elif track.model == "mfc":
        reach = track.max_dist or scans.agg(F.max(G.max_pair_distance())).first()[0] or 1.0
        points = G.track_mfc(blips, scans, track.slices, frames=mfc.frames, alpha=mfc.alpha, epsilon=mfc.epsilon, min_gain=mfc.min_gain, max_speed_kmh=track.max_speed_kmh, max_dist=reach)
    else:
        raise ValueError(f"unknown tracker: {track.model}")
    return G.filter_short_tracks(points, track.min_blips)


def detect_and_track(pulses: DataFrame, scans: DataFrame, params: Params | None = None, zones: DataFrame | None = None, clutter: DataFrame | None = None, stages: Stages | None = None) -> tuple[DataFrame, DataFrame]:
    """All sources and runs with one set of parameters: patches with is_blip, and the points of their tracks.

    zones: as in operators.filters; clutter: a map by learn_clutter (scans then have angle_class). Sources and runs are worked on side by side."""
    params = params or Params()
    scans = with_antenna(scans, params.antenna)
    patches, _ = detected(pulses, scans, params, zones, clutter, stages)
    patches = stored(patches)
    return patches, track_blips(patches.where("is_blip").withColumnRenamed("patch_id", "blip_id"), scans, params)
