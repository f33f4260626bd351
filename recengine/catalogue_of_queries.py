"""The registered queries of the recommender operators and their SQL equivalents."""

from recengine.plans import queries_data, queries_models  # noqa: F401  (they register themselves)
from recengine.plans.registry import ORACLE, QUERIES  # noqa: F401
