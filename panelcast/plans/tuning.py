"""Search over parameters: successive halving of tree boosters, and a user's own objectives and models."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators import boosting
from panelcast.operators.groups import attach
from panelcast.session import cut_lineage

# rows that one call of a user's function may get
GROUP_ROWS = 100_000
TUNED = ("depth", "rate", "least", "columns", "rounds")


def _pinball(y: Column, told: Column, level: float) -> Column:
    return F.greatest((y - told) * F.lit(level), (told - y) * F.lit(1 - level))


def held_out_losses(rows: DataFrame, model: boosting.Model, target: str) -> list[float]:
    """Mean pinball loss of every booster on ``rows``: one pass for all of them."""
    told = boosting.predict(rows.where(F.col(target).isNotNull()), model, [target])
    y = F.col(target).cast("double")
    losses = [F.avg(_pinball(y, F.col("_pred")[k], e.booster.level)).alias(f"l{k}") for k, e in enumerate(model.ensembles)]
    return list(told.agg(*losses).first())


def successive_halving(
    train: DataFrame, held_out: DataFrame, features: list[str], target: str, trials: list[boosting.Booster], rungs: list[int], keep: float = 1 / 3, bins: int = boosting.BINS
) -> DataFrame:
    """Every trial's held-out pinball loss on the rungs it reaches: (rung, trial, params, rounds, score, kept).

    The trials of a rung are grown together for its number of rounds on one table of bins, so that a pass
    over the rows serves all of them, and are scored in one job. The best share ``keep``, one at least, go
    on to the next rung; of equal scores the earlier trial. With ``keep=1`` it is an exhaustive search.
    """
    spark = train.sparkSession
    known = train.withColumns({"_y": F.col(target).cast("double"), "_day": F.lit(0)}).where("_y is not null and not isnan(_y)")
    cuts = boosting.feature_cuts(known, features, bins)
    table = cut_lineage(boosting.binned(known, features, cuts, ["_y", "_day"]))
    held = cut_lineage(held_out.select(target, *features))
    alive, out = list(range(len(trials))), []
    for rung, rounds in enumerate(rungs):
        grown = boosting.grow(table, [replace(trials[i], rounds=rounds) for i in alive], len(features), bins + 1)
        scores = dict(zip(alive, held_out_losses(held, boosting.Model(features, cuts, grown), target)))
        ranked = sorted((s if s is not None else float("inf"), i) for i, s in scores.items())
        staying = {i for _, i in ranked[:max(1, round(len(ranked) * keep))]} if rung < len(rungs) - 1 else {ranked[0][1]}
        for i in alive:
            params = {k: v for k, v in asdict(replace(trials[i], rounds=rounds)).items() if k in TUNED}
            out.append((rung, i, json.dumps(params, sort_keys=True), rounds, scores[i], i in staying))
        alive = sorted(staying)
    return spark.createDataFrame(out, "rung int, trial int, params string, rounds int, score double, kept boolean")


def _bounded(df: DataFrame, by: list[str], max_rows: int) -> tuple[DataFrame, DataFrame]:
    """``df`` without groups of more than ``max_rows`` rows, and those groups with their sizes. They are told by
    counts, before any group is sent to a task."""
    counts = cut_lineage(df.groupBy(*by).agg(F.count("*").alias("_rows")).where(F.col("_rows") > max_rows))
    rest = attach(df, counts, by, [c for c in df.columns if c not in by] or by).where("_rows is null").drop("_rows")
    return rest, counts


def run_trials(df: DataFrame, trials: list[dict], objective: Callable[[pd.DataFrame, dict], float], by: tuple[str, ...] = ("uf",), max_rows: int = GROUP_ROWS) -> DataFrame:
    """``objective(rows, params)`` for every parameter set and group: (by.., trial, params, score, error).

    A call gets all rows of its group as a pandas frame; calls run in parallel, each in a task's group. A
    call that raises, or gives no finite number, becomes a row with its error and no score. So does a group of
    more than ``max_rows`` rows, which is never gathered.
    """
    keys = list(by)
    fitting, large = _bounded(df, keys, max_rows)
    sets = [json.dumps(t, sort_keys=True) for t in trials]
    numbered = F.explode(F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(p).alias("params")) for i, p in enumerate(sets)]))
    schema = T.StructType([*(df.schema[c] for c in keys), T.StructField("trial", T.IntegerType()), T.StructField("params", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())])

    def call(rows: pd.DataFrame) -> pd.DataFrame:
        params, score, error = rows["params"].iloc[0], None, None
        try:
            score = float(objective(rows.drop(columns=["trial", "params"]), json.loads(params)))
            if not np.isfinite(score):
                score, error = None, "the objective is not a finite number"
        except Exception as problem:  # noqa: BLE001 - the user's function may raise anything; it is reported
            error = f"{type(problem).__name__}: {problem}"
        first = {c: [rows[c].iloc[0]] for c in keys}
        return pd.DataFrame({**first, "trial": [rows["trial"].iloc[0]], "params": [params], "score": [score], "error": [error]})

    done = fitting.select("*", numbered.alias("_t")).select(*df.columns, "_t.*").groupBy(*keys, "trial").applyInPandas(call, schema)
    refused = large.select(*keys, numbered.alias("_t"), "_rows").select(
        *keys, "_t.*", F.lit(None).cast("double").alias("score"), F.concat(F.lit("group has "), F.col("_rows"), F.lit(f" rows, the bound is {max_rows}")).alias("error"))
    return done.unionByName(refused)


def fold_scores(folds: DataFrame, factory: Callable[[], object], features: list[str], target: str, by: tuple[str, ...] = ("uf", "fold"), max_rows: int = GROUP_ROWS) -> DataFrame:
    """RMSE of a user's model per series and fold: (by.., rmse, error).

    ``factory()`` makes an object with ``fit(x, y)`` and ``predict(x)`` on arrays; ``folds`` has the column
    ``role``, train or test. Rows with a missing feature or target are left out of both.
    """

    def objective(rows: pd.DataFrame, _: dict) -> float:
        complete = rows.dropna(subset=[*features, target])
        train, test = (complete[complete["role"] == r] for r in ("train", "test"))
        if len(train) == 0 or len(test) == 0:
            raise ValueError("no complete rows to train on or to test")
        model = factory()
        model.fit(train[features].to_numpy(float), train[target].to_numpy(float))
        miss = model.predict(test[features].to_numpy(float)) - test[target].to_numpy(float)
        return float(np.sqrt(np.mean(miss**2)))

    found = run_trials(folds.select(*by, "role", *features, target), [{}], objective, by, max_rows)
    return found.select(*by, F.col("score").alias("rmse"), "error")
