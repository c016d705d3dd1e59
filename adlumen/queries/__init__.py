"""Registered queries: each operator over the order tables, with its SQL twin."""

from adlumen.queries import evaluation, features, models, relational  # noqa: F401
from adlumen.queries.registry import QUERIES, SQL  # noqa: F401
