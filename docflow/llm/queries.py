"""Imports every module of the subpackage, so that its queries are registered."""

from docflow.llm import ann, bpe, fingerprints, infill, jaccard, linedup, lm, packing, resample, suffixes, superkmers, toxicity, warc  # noqa: F401
from docflow.llm.registry import ORACLES, QUERIES  # noqa: F401
