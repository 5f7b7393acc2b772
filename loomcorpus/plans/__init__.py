"""Queries by area; importing this registers them all."""

from . import chat, corpus, extra, files, loading, metrics, packing, retrieval, runs, scaling, tasks, tokens  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
