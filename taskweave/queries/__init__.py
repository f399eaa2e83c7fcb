"""The registered queries."""

from taskweave.queries import calls, catalogs, metrics, pairs, retrieval, stores, tokens, votes  # noqa: F401
from taskweave.queries.registry import QUERIES, SQL  # noqa: F401
