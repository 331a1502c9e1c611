"""Out-of-fold probabilities to a checked submission with its manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.operators import heads, tuning
from foldwright.operators.profile import prediction_mix, table_digest
from foldwright.operators.single import beside
from foldwright.operators.validate import assert_ok, validate_probs, validate_submission
from foldwright.operators.vectors import ensemble
from foldwright.schema import CLASS_NAMES
from foldwright.session import freeze
from foldwright.sources.tables import submission


@dataclass
class Decision:
    submission: DataFrame
    nested_folds: DataFrame
    summary: DataFrame
    mix: DataFrame
    manifest: DataFrame
    multipliers: list[float]


def refit_ensemble(compositions: Mapping[str, tuple[DataFrame, DataFrame, str]],
                   weights: Mapping[str, float] | None, k: int, seed: int = 42) -> DataFrame:
    """(key, probs) for the test rows: each composition (train, test, head) refit on all train rows."""
    sets = {name: heads.fit_predict(train, test, head, k, seed).select("key", "probs")
            for name, (train, test, head) in compositions.items()}
    return ensemble(sets, weights, k)


def manifest(number: int, team: str, sub: DataFrame, folds: DataFrame, artefacts: Mapping[str, DataFrame],
             summary: DataFrame, multipliers: Sequence[float], weights: Mapping[str, float] | None = None,
             notes: str = "", names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """One nested row that ties a submission to the exact tables and settings behind it."""
    def digest(df, name):
        return table_digest(df).select(F.struct("*").alias(name))

    row = beside(digest(sub.select("pos", "id", "predicted"), "submission_digest"), digest(folds, "folds_digest"),
                 *[digest(df, f"digest_{name}") for name, df in artefacts.items()],
                 summary.select(F.struct("*").alias("cv_estimate")))
    used = F.map_from_arrays(F.array(*[F.lit(n) for n in weights]), F.array(*[F.lit(float(w)) for w in weights.values()])) \
        if weights else F.lit(None).cast("map<string,double>")
    return row.withColumns({
        "submission_number": F.lit(number), "team_name": F.lit(team),
        "timestamp_utc": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                                       "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        "active_compositions": F.array(*[F.lit(n) for n in artefacts]), "ensemble_weights": used,
        "multipliers": F.map_from_arrays(F.array(*[F.lit(f"w{i}_{names[i]}") for i in range(len(multipliers))]),
                                         F.array(*[F.lit(float(m)) for m in multipliers])),
        "notes": F.lit(notes)})


def decide(oof_sets: Mapping[str, DataFrame], test_sets: Mapping[str, DataFrame], template: DataFrame,
           weights: Mapping[str, float] | None = None, k: int = 3, grid: Sequence[Sequence[float]] | None = None,
           number: int = 1, team: str = "", notes: str = "", names: Sequence[str] = CLASS_NAMES) -> Decision:
    """Blend, validate, tune, predict, check. Raises before anything is returned if a check fails.

    oof_sets: key, fold, label, probs. test_sets: key, probs, where key is the template's id.
    One weight rule and one grid serve both the out-of-fold and the test side.
    """
    oof = freeze(ensemble(oof_sets, weights, k))
    assert_ok(validate_probs(oof, k, expected=next(iter(oof_sets.values()))))
    grid = tuning.multiplier_grid() if grid is None else grid
    counts = freeze(tuning.multiplier_counts(oof, grid, k))  # candidates x folds x K x K rows
    nested_folds, summary = tuning.nested_multipliers(oof, grid, k, counts)
    best = tuning.tune_multipliers(oof, grid, k, counts).first()
    multipliers = [best[f"w{i}"] for i in range(k)]

    probs = ensemble(test_sets, weights, k)
    pred = tuning.apply_multipliers(probs, multipliers).select(F.col("key").alias("id"), "predicted")
    sub = freeze(submission(pred, template))
    assert_ok(validate_submission(sub, template, k))
    record = manifest(number, team, sub, oof.select("key", "label", "fold"), oof_sets, summary, multipliers,
                      weights, notes, names)
    return Decision(sub, nested_folds, summary, prediction_mix(sub, k), record, multipliers)
