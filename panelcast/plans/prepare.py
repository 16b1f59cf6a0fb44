"""End-to-end preparation: cleaning to model-ready features, all series in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window

from panelcast.operators import features as ft
from panelcast.operators.groups import attach
from panelcast.operators.merge import aggregate_to_state, merge_sources
from panelcast.operators.prep import clean, epi_features, impute, normalize, numeric_columns
from panelcast.series import Series, over_chunks
from panelcast.session import cut_lineage


def prepare_for_modeling(
    df: DataFrame,
    target: str = "casos",
    order: str | None = None,
    imputation: str | None = "seasonal",
    epi: bool = True,
    normalized: bool = False,
    s: Series = Series(),
) -> DataFrame:
    """Clean, impute, add epidemiological columns, optionally normalize, drop NULL targets.

    Cleaning and imputing each look at their input several times, for the rows and for
    statistics of them, so the panel is written between these steps.
    """
    df = cut_lineage(clean(df, order, s=s))
    if imputation:
        df = impute(df, imputation, s=s)
    if epi:
        df = epi_features(df)
    if normalized:
        skip = {*ft.NOT_FEATURES, target, *s.key}
        df = normalize(cut_lineage(df), [c for c in numeric_columns(df) if c not in skip], s=s)
    return df.dropna(subset=[target])


def build_feature_set(
    df: DataFrame,
    target: str = "casos",
    edges: DataFrame | None = None,
    ocean: DataFrame | None = None,
    horizon: int = ft.HORIZON,
    lags: list[int] = ft.LAGS,
    windows: list[int] = ft.WINDOWS,
    periods: list[int] = ft.DIFF_PERIODS,
    drop_incomplete: bool = True,
    s: Series = Series(),
) -> DataFrame:
    """Calendar and climate columns, every lag, rolling, difference and horizon column in
    a single chunked pass, and spatial and ocean columns joined to it.

    The panel is written first: numbering rows, chunks, neighbours and dates each read a
    few of its columns, none of them the raw tables behind it.
    """
    base = cut_lineage(ft.climate_features(ft.time_features(df, s.time)))

    def build(w: Window) -> dict[str, Column]:
        return {
            **ft.lag_exprs(w, target, lags),
            **ft.rolling_exprs(w, target, windows, ft.STATS),
            **ft.diff_exprs(w, target, periods),
            **ft.horizon_exprs(w, target, horizon),
        }

    out = over_chunks(base, build, s, before=max(*lags, *windows, *periods), after=horizon)
    if edges is not None:
        out = out.join(ft.spatial_means(base, edges, target, s), [*s.key, s.time], "left")
    if ocean is not None:
        found = ft.ocean_lookup(base.select(s.time).distinct(), ocean, time=s.time)
        out = attach(out, found, [s.time], list(s.key))
    out = out.dropna(subset=[target])
    return out.dropna("any") if drop_incomplete else out


def prepare_states(
    dengue: DataFrame,
    climate: DataFrame | None = None,
    population: DataFrame | None = None,
    environ: DataFrame | None = None,
    edges: DataFrame | None = None,
    states: list[str] | None = None,
    target: str = "casos",
    s: Series = Series(),
) -> DataFrame:
    """Raw tables to the feature table of all (or the given) states."""
    panel = aggregate_to_state(merge_sources(dengue, climate, population, environ, states))
    cleaned = cut_lineage(clean(cut_lineage(panel), s=s))
    ready = epi_features(impute(cleaned, "seasonal", s=s))
    full = build_feature_set(ready, target, edges, drop_incomplete=False, s=s)
    return ft.select_features(full, target, s=s)
