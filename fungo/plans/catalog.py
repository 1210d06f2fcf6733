"""Every registered query and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fungo.sources.views import Tables, with_views

from . import boards, display, grading, market, quality, reports, scoring, serving, training, verdicts

MODULES = (display, training, grading, quality, market, serving, boards, scoring, verdicts, reports)


def _query(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Tables(spark, sf_dir))


QUERIES = {name: _query(plan[0]) for m in MODULES for name, plan in m.PLANS.items()}
ORACLES = {name: with_views(plan[1]) for m in MODULES for name, plan in m.PLANS.items() if plan[1]}
