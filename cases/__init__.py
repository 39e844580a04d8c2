"""Registered queries over the driver tables, each beside its SQL oracle."""

from importlib import import_module

MODULES = ["listing_cases", "text_cases", "linkage_cases", "plan_cases", "extract_cases", "board_cases", "flow_cases", "run_cases"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"cases.{name}")
