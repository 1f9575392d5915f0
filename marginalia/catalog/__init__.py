"""Registered queries, grouped by topic."""

from __future__ import annotations

from importlib import import_module

TOPICS = ["study", "text", "retrieval", "library", "reports", "decks", "streams"]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for topic in TOPICS:
        try:
            module = import_module(f"{__name__}.{topic}")
        except ModuleNotFoundError as error:
            if error.name != f"{__name__}.{topic}":
                raise
            continue
        for name, value in getattr(module, attribute).items():
            if name in out:
                raise ValueError(f"query registered twice: {name}")
            out[name] = value
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")
