"""Named queries over the driver tables (one per operator of SURVEY §2)."""

from raterlens.plans.base import ORACLES, QUERIES  # noqa: F401
from raterlens.plans import (  # noqa: F401  (registration side effects)
    cleaning,
    ingest,
    profiling,
    labelling,
    evaluation,
    welfare,
    splits,
    benchmark,
    scoring,
)


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
