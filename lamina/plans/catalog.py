"""Imports every module that registers queries."""

from lamina.plans import engine, graph, indexes, retrieval, rules, stores, streams, texts  # noqa: F401
from lamina.plans.registry import ORACLES, QUERIES  # noqa: F401
