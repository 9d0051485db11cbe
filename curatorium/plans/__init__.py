"""Queries over the projected tables, one module per operator family."""

from importlib import import_module

MODULES = ["requests", "scans", "predicates", "checks", "joins", "aggregates", "selection", "sets", "texts", "ledgers", "pixels", "flows", "streams", "temporal", "summaries", "distributions", "sql_text"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"curatorium.plans.{name}")
