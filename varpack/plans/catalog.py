"""Imports every query module so the registry is complete."""

from . import q_classify, q_core, q_deck, q_extracts, q_findings, q_ingest, q_text, q_views  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
