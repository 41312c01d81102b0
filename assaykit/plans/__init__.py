"""Registered queries; importing this package registers them all."""

from . import board, curation, files, grading, solids, streams, texts, viewer  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
