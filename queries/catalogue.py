"""Imports every query module so that its queries are registered."""

from queries import evaluation, jobs, matrices, relations, scalars, storage  # noqa: F401
from queries.base import ORACLES, QUERIES  # noqa: F401
