"""Ranking models over tests, and what states can learn from each other.

Metric tables have one row per ``(uf, test, model)``.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import ratio
from panelcast.operators.groups import attach, top_per_group
from panelcast.series import Series, in_order, numbered

AVERAGED = [
    "crps", "wis_total", "rmse", "mae", "mape", "bias",
    "coverage_50", "coverage_80", "coverage_90", "coverage_95",
]

# Weights of the composite score.
COMPOSITE = {"crps": 0.35, "wis_total": 0.25, "mae": 0.20, "coverage_95": 0.15, "bias": 0.05}
MISSING_SCORE = 1e6


def average_over_tests(metrics: DataFrame, by: tuple[str, ...] = ("uf", "model")) -> DataFrame:
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(c) for c in AVERAGED if c in metrics.columns])


def composite_score() -> Column:
    """Lower is better; a missing error metric counts as a million."""

    def error(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(MISSING_SCORE)) * COMPOSITE[c]

    miss = F.abs(F.coalesce(F.col("coverage_95"), F.lit(0.95)) - 0.95) * 1000.0 * COMPOSITE["coverage_95"]
    lean = F.abs(F.coalesce(F.col("bias"), F.lit(0.0))) / 1000.0 * COMPOSITE["bias"]
    return error("crps") + error("wis_total") + error("mae") + miss + lean


def consistency_score(metrics: DataFrame, by: tuple[str, ...] = ("uf", "model")) -> DataFrame:
    """One minus the coefficient of variation of CRPS over tests, at least zero."""
    spread = ratio(F.stddev_pop("crps"), F.avg("crps"))
    steady = (F.count("crps") < 2) | (F.avg("crps") == 0)
    return metrics.groupBy(*by).agg(
        F.when(steady, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - spread)).alias("consistency")
    )


def qualifying_models(
    metrics: DataFrame, min_coverage: float = 0.85, max_bias: float = 500.0, min_tests: int = 3, by: tuple[str, ...] = ("uf",)
) -> DataFrame:
    """Mean scores and consistency of every model scored on every test that meets the
    coverage and bias criteria, however many there are. One aggregation."""
    cv = ratio(F.stddev_pop("crps"), F.avg("crps"))
    table = metrics.groupBy(*by, "model").agg(
        *[F.avg(c).alias(c) for c in AVERAGED if c in metrics.columns],
        F.when((F.count("crps") < 2) | (F.avg("crps") == 0), F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.0), 1.0 - cv))
        .alias("consistency"),
        F.count_distinct("test").alias("n_tests"),
    )
    return table.where(
        (F.col("n_tests") >= min_tests)
        & (F.coalesce(F.col("coverage_95"), F.lit(0.0)) >= min_coverage)
        & (F.abs(F.coalesce(F.col("bias"), F.lit(0.0))) <= max_bias)
    )


def select_top_models(
    metrics: DataFrame,
    n_top: int = 3,
    min_coverage: float = 0.85,
    max_bias: float = 500.0,
    min_tests: int = 3,
    by: tuple[str, ...] = ("uf",),
) -> DataFrame:
    """The best of the :func:`qualifying_models` of each group."""
    good = qualifying_models(metrics, min_coverage, max_bias, min_tests, by)
    scored = good.withColumn("performance_score", composite_score()).withColumn(
        "combined_score", F.col("performance_score") * (1.0 + (1.0 - F.col("consistency")) * 0.2)
    )
    return top_per_group(scored, list(by), [F.col("combined_score"), F.col("model")], n_top).select(
        *by, "model", "rank", "combined_score", "performance_score", "consistency"
    )


def selection_report(
    metrics: DataFrame, selected: DataFrame, by: tuple[str, ...] = ("uf",), tests: tuple[str, ...] = ("1", "2", "3")
) -> DataFrame:
    """Average and per-test value of each metric of the selected models, with a column for each of ``tests``."""
    names = ["crps", "wis_total", "rmse", "mae", "mape", "bias", "coverage_95"]
    rows = metrics.join(selected.select(*by, "model", "rank"), [*by, "model"])
    long = rows.unpivot([*by, "model", "rank", "test"], names, "metric", "value")
    return long.groupBy(*by, "model", "rank", "metric").agg(
        F.avg("value").alias("average"),
        *[F.max(F.when(F.col("test") == t, F.col("value"))).alias(f"test_{t}") for t in tests],
    )


def knowledge_score() -> Column:
    """Score by which a state's best parameters are kept; lower is better."""
    miss = F.abs(F.col("coverage_95") - 0.95) + F.abs(F.col("coverage_50") - 0.50)
    return F.col("crps") * 0.5 + F.col("wis_total") * 0.3 + miss * 1000.0 * 0.2


def best_parameters(results: DataFrame, by: tuple[str, ...] = ("uf", "model")) -> DataFrame:
    """Lowest-scoring result per group with its parameters; ties go to the earlier test."""
    scored = results.withColumn("score", knowledge_score())
    pick = F.struct("score", "test")
    return scored.groupBy(*by).agg(
        F.min("score").alias("score"), F.min_by("test", pick).alias("test"), F.min_by("params", pick).alias("params")
    )


def best_from_states(best: DataFrame, states: DataFrame, model: str) -> DataFrame:
    """For each ``uf`` of ``states(uf, similar_uf)``, the best parameters among its similar states."""
    offered = best.where(F.col("model") == model).select(
        F.col("uf").alias("similar_uf"), "params", "score"
    )
    return (
        states.select("uf", "similar_uf")
        .join(offered, "similar_uf")
        .groupBy("uf")
        .agg(
            F.min_by("params", F.struct("score", "similar_uf")).alias("params"),
            F.min_by("similar_uf", F.struct("score", "similar_uf")).alias("source_state"),
            F.min("score").alias("score"),
        )
    )


# Weight of each criterion of state similarity, and the column it compares.
SIMILARITY = {"climate": 0.3, "biome": 0.3, "population": 0.2, "pattern": 0.2}
CRITERION_COLUMN = {"climate": "climate_zone", "biome": "biome", "pattern": "historical_pattern"}
PROVEN = 1.2


def similar_states(
    profiles: DataFrame,
    n: int = 3,
    criteria: tuple[str, ...] = ("climate", "biome", "pattern"),
    proven: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` most similar other states of every state.

    Pairs are not enumerated. A partner's score follows from the set of criteria it
    matches and from whether it has results (``proven``), plus the population ratio if
    asked for. For each set of criteria the candidates are therefore the first few
    states of the group sharing those values, best first; a state outside that list has
    ``n`` states before it that score at least as well. With population, each group
    offers the first states of the nearest populations on either side instead.
    """
    columns = [CRITERION_COLUMN[c] for c in criteria if c in CRITERION_COLUMN]
    rows = profiles.withColumn("_proven", F.lit(False))
    if proven is not None:
        seen = proven.select(F.col("state_uf")).distinct().withColumn("_seen", F.lit(True))
        rows = (
            profiles.join(seen, "state_uf", "left")
            .withColumn("_proven", F.coalesce("_seen", F.lit(False)))
            .drop("_seen")
        )
    other = F.struct("state_uf", "population", "_proven", *columns)
    found = []
    for size in range(len(columns) + 1):
        for shared in combinations(columns, size):
            if "population" in criteria:
                found.append(_nearest_population(rows, list(shared), other, n))
            else:
                found.append(_first_of_group(rows, list(shared), other, n))
    pairs = reduce(DataFrame.unionByName, found).distinct()
    score = F.lit(0.0)
    for c in criteria:
        if c == "population":
            low = F.least("population", F.col("o.population"))
            high = F.greatest("population", F.col("o.population"))
            score = score + ratio(low, high) * SIMILARITY[c]
        else:
            name = CRITERION_COLUMN[c]
            score = score + F.when(F.col(name) == F.col(f"o.{name}"), SIMILARITY[c]).otherwise(0.0)
    score = F.when(F.col("o._proven"), score * PROVEN).otherwise(score)
    scored = pairs.select("state_uf", F.col("o.state_uf").alias("similar_uf"), score.alias("score"))
    # equal sums of weights may differ in the last bit
    order = [F.round("score", 9).desc(), F.col("similar_uf")]
    return top_per_group(scored, ["state_uf"], order, n)


def _first_of_group(rows: DataFrame, shared: list[str], other: Column, n: int) -> DataFrame:
    order = [F.col("state_uf")] if not shared else [F.col("_proven").desc(), F.col("state_uf")]
    if shared:
        best = top_per_group(rows.withColumn("o", other), shared, order, n + 1).groupBy(*shared)
    else:
        best = rows.withColumn("o", other).orderBy(*order).limit(n + 1).groupBy()
    lists = best.agg(F.collect_list("o").alias("_c"))
    return (
        attach(rows, lists, shared, ["state_uf"])
        .select(*rows.columns, F.explode("_c").alias("o"))
        .where(F.col("o.state_uf") != F.col("state_uf"))
    )


def _nearest_population(rows: DataFrame, shared: list[str], other: Column, n: int) -> DataFrame:
    """Candidates of every state within its group, once among proven and once among unproven
    partners, since the bonus changes the order: the first ``n + 1`` names of its own population
    and of each of the ``n`` nearest ones on either side.

    Different populations are numbered, not states, so many alike cost no more than one.
    """
    at = [*shared, "population"]
    first = top_per_group(rows.withColumn("o", other), [*at, "_proven"], [F.col("state_uf")], n + 1)
    of = lambda flag: F.collect_list(F.when(F.col("_proven") == F.lit(flag), F.col("o")))
    s = Series(key=tuple(shared), time="population")
    ordered = in_order(first.groupBy(*at).agg(of(True).alias("_proven"), of(False).alias("_unproven")), s)
    sides = []
    for name in ("_proven", "_unproven"):
        wanted = F.size(name) > 0
        placed = numbered(ordered, s, wanted)
        partners = placed.where(wanted).select(*shared, "_pos", F.col(name).alias("_c"))
        probes = placed.select(*at, F.explode(F.sequence(F.col("_pos") - n, F.col("_pos") + n)).alias("_pos"))
        near = attach(probes, partners, [*shared, "_pos"], ["population"]).where("_c is not null")
        lists = near.groupBy(*at).agg(F.flatten(F.collect_list("_c")).alias("_c"))
        sides.append(
            attach(rows, lists, at, ["state_uf"])
            .select(*rows.columns, F.explode("_c").alias("o"))
            .where(F.col("o.state_uf") != F.col("state_uf"))
        )
    return reduce(DataFrame.unionByName, sides)


def zone_insights(metrics: DataFrame, profiles: DataFrame) -> DataFrame:
    """Best state, its CRPS and the mean CRPS of each climate zone."""
    states = metrics.groupBy("uf").agg(F.avg("crps").alias("crps"))
    zoned = states.join(profiles.select(F.col("state_uf").alias("uf"), "climate_zone"), "uf")
    return zoned.groupBy("climate_zone").agg(
        F.min_by("uf", F.struct("crps", "uf")).alias("best_state"),
        F.min("crps").alias("best_crps"),
        F.avg("crps").alias("avg_crps"),
    )


def tuning_recommendations(metrics: DataFrame, similar: DataFrame) -> DataFrame:
    """Flags on each state's and model's latest test, with the similar states whose CRPS
    fell from the first to the third test."""
    at = lambda t, c: F.max(F.when(F.col("test") == t, F.col(c)))
    progress = (
        metrics.groupBy("uf", "model")
        .agg((at("1", "crps") - at("3", "crps")).alias("improvement"))
        .where(F.col("improvement") > 0)
        .select(F.col("uf").alias("similar_uf"), "model", "improvement")
    )
    learned = (
        similar.select(F.col("state_uf").alias("uf"), "similar_uf")
        .join(progress, "similar_uf")
        .groupBy("uf", "model")
        .agg(
            F.count(F.lit(1)).alias("n_improved"),
            F.max("improvement").alias("max_improvement"),
        )
    )
    latest = metrics.groupBy("uf", "model").agg(
        *[F.max_by(c, "test").alias(c) for c in ("coverage_95", "coverage_50", "bias")]
    )
    flags = latest.select(
        "uf",
        "model",
        (F.col("coverage_95") < 0.90).alias("coverage_issue"),
        ((F.col("coverage_50") < 0.45) | (F.col("coverage_50") > 0.55)).alias("calibration_issue"),
        F.when(F.col("bias") > 100, "overestimating").when(F.col("bias") < -100, "underestimating").alias("bias_issue"),
    )
    return flags.join(learned, ["uf", "model"], "left").withColumn(
        "n_improved", F.coalesce("n_improved", F.lit(0).cast("bigint"))
    )


# Base score of each model family and the boosts of particular states.
BASE_SCORES = {"xgboost": 0.85, "prophet": 0.75, "tft": 0.70, "nbeats": 0.65, "lstm": 0.60}
STATE_BOOSTS = [
    (("SP", "RJ", "CE", "PE", "BA"), {"prophet": 0.1, "nbeats": 0.05}),
    (("SP", "RJ", "MG"), {"tft": 0.1, "lstm": 0.05}),
    (("AC", "AP", "RR", "RO"), {"prophet": 0.1, "lstm": -0.1, "tft": -0.05}),
]

# Multipliers by data size, feature count and missing values.
SMALL_DATA, LARGE_DATA, MANY_FEATURES = 300, 1000, 20
SMALL_FACTORS = {"lstm": 0.7, "tft": 0.7, "prophet": 1.1}
LARGE_FACTORS = {"lstm": 1.1, "tft": 1.1}
WIDE_FACTORS = {"xgboost": 1.15, "tft": 1.1}
MISSING_FACTORS = {"xgboost": 1.1, "prophet": 1.05}

# Strengths of each model family and how easily it is interpreted.
MODEL_STRENGTHS = {
    "xgboost": ["seasonality", "trend", "feature_importance"],
    "lstm": ["long_term_patterns", "complex_dynamics"],
    "prophet": ["seasonality", "trend_changepoints", "holidays"],
    "tft": ["attention", "interpretability", "variable_selection"],
    "nbeats": ["trend_decomposition", "seasonality"],
}
INTERPRETABILITY = {"xgboost": "high", "lstm": "low", "prophet": "high", "tft": "high", "nbeats": "moderate"}


def reasons(model: str) -> list[str]:
    """What speaks for a model family, from its strengths."""
    have = set(MODEL_STRENGTHS[model])
    rules = [
        ("handles seasonality well", "seasonality" in have),
        ("captures trend patterns", bool(have & {"trend", "trend_decomposition"})),
        ("highly interpretable", "interpretability" in have and INTERPRETABILITY[model] == "high"),
    ]
    return [text for text, holds in rules if holds]


def preselect_models(
    profile: DataFrame, n: int = 3, boosts: list[tuple] = STATE_BOOSTS, history: DataFrame | None = None
) -> DataFrame:
    """Model families to train for each state of ``profile(uf, data_size, n_features,
    has_missing)``, best first. ``history(uf, model, score)`` replaces the base scores."""

    def base(model: str) -> Column:
        value = F.lit(BASE_SCORES[model])
        for states, changes in boosts:
            if model in changes:
                value = value + F.when(F.col("uf").isin(list(states)), changes[model]).otherwise(0.0)
        return value

    if history is None:
        models = F.array(*[F.struct(F.lit(m).alias("model"), base(m).alias("score")) for m in BASE_SCORES])
        rows = profile.select("*", F.inline(models))
    else:
        models = F.explode(F.array(*[F.lit(m) for m in BASE_SCORES])).alias("model")
        known = history.select("uf", "model", F.col("score").alias("_h"))
        rows = (
            profile.select("*", models)
            .join(known, ["uf", "model"], "left")
            .withColumn("score", F.coalesce("_h", F.lit(0.5)))
            .drop("_h")
        )

    def factor(table: dict[str, float], condition: Column) -> Column:
        value = F.lit(1.0)
        for model, f in table.items():
            value = F.when(condition & (F.col("model") == model), f).otherwise(value)
        return value

    score = (
        F.col("score")
        * factor(SMALL_FACTORS, F.col("data_size") < SMALL_DATA)
        * factor(LARGE_FACTORS, F.col("data_size") > LARGE_DATA)
        * factor(WIDE_FACTORS, F.col("n_features") > MANY_FEATURES)
        * factor(MISSING_FACTORS, F.col("has_missing"))
    )
    scored = rows.select("uf", "model", score.alias("score"))
    top = top_per_group(scored, ["uf"], [F.round("score", 9).desc(), F.col("model")], n, "priority")
    level = F.when(F.col("score") > 0.8, F.concat(F.lit("High historical performance in "), "uf")).when(
        F.col("score") > 0.6, F.concat(F.lit("Good match for "), "uf", F.lit("'s characteristics"))
    )
    fixed = F.lit(None).cast("array<string>")
    for m in MODEL_STRENGTHS:
        fixed = F.when(F.col("model") == m, F.array(*[F.lit(r) for r in reasons(m)]).cast("array<string>")).otherwise(fixed)
    given = F.array_compact(F.concat(F.array(level), fixed))
    text = F.when(F.size(given) > 0, F.array_join(given, ", ")).otherwise("general purpose model")
    return top.withColumn("reasoning", F.concat(F.upper("model"), F.lit(": "), text))


def history_scores(results: DataFrame, by: tuple[str, ...] = ("uf", "model")) -> DataFrame:
    """Mean of 0.5 and ``1/(1+crps/100)`` of every past result with a positive CRPS."""
    usable = F.when((F.col("crps") > 0) & (F.col("crps") < float("inf")), F.col("crps"))
    gain = F.lit(1.0) / (1.0 + usable / 100.0)
    return results.groupBy(*by).agg(
        ((F.lit(0.5) + F.coalesce(F.sum(gain), F.lit(0.0))) / (F.count(usable) + 1)).alias("score")
    )


def best_over_tests(results: DataFrame, by: tuple[str, ...] = ("uf", "model")) -> DataFrame:
    """First non-empty parameters in test order."""
    filled = F.when(F.col("params") != "", F.col("test"))
    return results.groupBy(*by).agg(F.min_by("params", filled).alias("params"), F.min(filled).alias("test"))


def structure_by_model(metrics: DataFrame) -> DataFrame:
    """The results of each model as a map from test to its scores."""
    entry = F.struct("test", F.struct("crps", "wis_total", "rmse", "mae").alias("scores"))
    return metrics.groupBy("uf", "model").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("tests"))


# The thresholds and parameter names of the tuning rules below.
def focus_areas(metrics: DataFrame, by: tuple[str, ...] = ("uf", "model")) -> DataFrame:
    """Parameters to tune first, from the latest test of each group."""
    latest = metrics.groupBy(*by).agg(*[F.max_by(c, "test").alias(c) for c in ("coverage_95", "bias", "mape")])
    rules = [
        (F.coalesce(F.col("coverage_95"), F.lit(0.95)) < 0.90, ["subsample", "colsample_bytree"]),
        (F.abs(F.coalesce(F.col("bias"), F.lit(0.0))) > 100, ["learning_rate", "gamma"]),
        (F.coalesce(F.col("mape"), F.lit(0.0)) > 50, ["max_depth", "min_child_weight"]),
    ]
    none = F.array().cast("array<string>")
    found = F.concat(*[F.when(c, F.array(*[F.lit(p) for p in names])).otherwise(none) for c, names in rules])
    default = F.array(F.lit("learning_rate"), F.lit("n_estimators"))
    return latest.select(*by, F.array_sort(F.when(F.size(found) > 0, found).otherwise(default)).alias("focus"))


# Parameters of a round that has none of its own.
DEFAULT_PARAMETERS = {
    "xgboost": {"max_depth": 6, "learning_rate": 0.05, "subsample": 0.8},
    "lstm": {"hidden_size": 128, "num_layers": 2},
}


def suggest_parameters(rounds: DataFrame, family: str = "xgboost") -> DataFrame:
    """Next parameters from the scores of a round, as ``next_<parameter>``.

    ``rounds`` carries ``rmse, mae, coverage_95`` and the parameters of the ``family``; where one of
    them is NULL the family's defaults come next. A heavy error tail asks for deeper and slower trees
    or for a larger network; low coverage for a smaller subsample. Other families keep theirs.
    """
    heavy = F.coalesce(F.col("rmse") > F.col("mae") * 2, F.lit(False))
    low = F.coalesce(F.col("coverage_95") < 0.85, F.lit(False))
    steps = {
        "xgboost": {
            "max_depth": F.when(heavy, F.least(F.lit(10), F.col("max_depth") + 1)),
            "learning_rate": F.when(heavy, F.col("learning_rate") * 0.9),
            "subsample": F.when(low, F.greatest(F.lit(0.6), F.col("subsample") - 0.1)),
        },
        "lstm": {
            "hidden_size": F.when(heavy, F.least(F.lit(256), F.col("hidden_size") * 2)),
            "num_layers": F.when(heavy, F.least(F.lit(3), F.col("num_layers") + 1)),
        },
    }
    return rounds.withColumns(
        {
            f"next_{c}": F.when(F.col(c).isNull(), F.lit(DEFAULT_PARAMETERS[family][c])).otherwise(F.coalesce(step, F.col(c)))
            for c, step in steps.get(family, {}).items()
        }
    )


def convergence(
    scores: DataFrame,
    by: tuple[str, ...],
    order: str,
    patience: int = 5,
    min_improvement: float = 0.001,
    min_iterations: int = 5,
) -> DataFrame:
    """Replay a search per group: best score, iteration at which it would stop, and
    whether it converged. A score counts as progress when it beats the best by more than
    ``min_improvement`` relative.

    A group holds the iterations of one search, whose budget bounds it.
    """
    history = scores.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("i"), F.col("score").cast("double").alias("x")))).alias("_h"))
    start = F.struct(
        F.lit(None).cast("double").alias("best"),
        F.lit(0).alias("idle"),
        F.lit(0).alias("n"),
        F.lit(None).cast("int").alias("stop"),
    )

    def step(acc: Column, p: Column) -> Column:
        first = acc["best"].isNull()
        gain = (acc["best"] - p["x"]) / (F.abs(acc["best"]) + 1e-8)
        better = first | ((p["x"] < acc["best"]) & (gain > min_improvement))
        n = acc["n"] + 1
        idle = F.when(first, 0).when(better, 0).otherwise(acc["idle"] + 1)
        halt = (n >= min_iterations) & (idle >= patience)
        moved = F.struct(
            F.when(better, p["x"]).otherwise(acc["best"]).alias("best"),
            idle.alias("idle"),
            n.alias("n"),
            F.when(halt, n).alias("stop"),
        )
        return F.when(acc["stop"].isNotNull(), acc).otherwise(moved)

    folded = history.withColumn("_r", F.aggregate("_h", start, step))
    return folded.select(
        *by,
        F.col("_r.best").alias("best_score"),
        F.col("_r.n").alias("iterations"),
        F.col("_r.stop").isNotNull().alias("converged"),
    )
