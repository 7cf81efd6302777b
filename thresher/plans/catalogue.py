"""All registered queries."""

from thresher.plans import assembling, calibrating, expressions, flows, joining, measuring, modelling, scans, selecting, streams  # noqa: F401
from thresher.plans.registry import QUERIES

__all__ = ["QUERIES"]
