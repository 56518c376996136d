"""Registered queries; importing the modules registers them."""

from . import catalogue, code, lookups, more, retrieval  # noqa: F401
