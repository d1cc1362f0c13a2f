"""Registered queries over the given tables, each with equivalent SQL where SQL can say it."""

from threadloom.catalog import jobs, labelling, models, scoring, texts, topics  # noqa: F401
from threadloom.catalog.registry import ENTRIES  # noqa: F401
