"""Imports every query module so that the registry is complete."""

from tokenmill.plans import q_text, q_scores, q_bleu, q_runs, q_bpe, q_decode, q_io, q_stream, q_longtext  # noqa: F401
from tokenmill.plans.registry import ORACLES, QUERIES  # noqa: F401
