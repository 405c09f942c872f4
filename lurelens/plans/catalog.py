"""Importing this module registers every query."""

from lurelens.plans import q_links, q_domains, q_features, q_verdict, q_enrich, q_text, q_indicators, q_analytics, q_models, q_streaming, q_sources  # noqa: F401
from lurelens.plans.registry import ORACLES, QUERIES  # noqa: F401
