"""Registered queries: importing this package registers all of them."""

from maskwright.plans import contracts, evaluation, features, forms, learners, likeness, poses, sampling, shapes  # noqa: F401
from maskwright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
