"""All registered queries."""

from renderscope.plans import evidence, ratings, selection, stats, streams, texts  # noqa: F401
from renderscope.plans.registry import QUERIES, SQL  # noqa: F401
