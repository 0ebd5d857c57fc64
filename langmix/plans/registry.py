"""Imports every query module so that all keys are registered."""

from langmix.plans import catalog, q_detect, q_eval, q_files, q_labels, q_learn, q_pairs, q_small, q_sources, q_stream  # noqa: F401
from langmix.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
