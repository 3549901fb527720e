"""All queries; importing their modules registers them."""

from __future__ import annotations

from . import entity_queries, extension_queries, kept_queries, listing_queries, source_queries, text_queries, upkeep_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "entity_queries", "extension_queries", "kept_queries", "listing_queries", "source_queries", "text_queries", "upkeep_queries"]
