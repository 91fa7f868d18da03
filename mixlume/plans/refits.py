"""Queries on interaction models of the recipes with a chosen ridge, and on their refits."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixlume.operators import refits
from mixlume.plans.entities import LOSSES, MIX, cut
from mixlume.plans.mixture import recipe_table
from mixlume.plans.registry import query

_REPS = 30


@query("m3_chosen_ridge", None, "beta cv_rmse")
def _(spark, d):
    """The interaction model of all recipes, its ridge chosen for each loss."""
    return refits.coefficients(refits.fits(recipe_table(spark, d), "idx", MIX, LOSSES), MIX)


def _choices(spark, d):
    rec = recipe_table(spark, d)
    fitted = cut(refits.fits(rec, "idx", MIX, LOSSES, _REPS), "refits")
    mean_b = rec.agg(F.avg("loss_b")).first()[0]
    spread = F.greatest(*MIX) <= 0.5
    policies = {"all": ("mean", F.lit(True)), "low_b": ("mean", F.col("loss_b") <= F.lit(mean_b)), "spread": ("mean", spread), "minimax": ("max", F.lit(True))}
    return refits.choices(rec, "idx", MIX, LOSSES, fitted, policies)


@query("r9_refit_choices", None, "refit_regret frozen_regret")
def _(spark, d):
    """What each of 30 refits on 80 % of the recipes chooses under four policies."""
    return _choices(spark, d)


@query("r9_refit_stability", None, "same_share median_regret max_regret")
def _(spark, d):
    return refits.summary(_choices(spark, d))
