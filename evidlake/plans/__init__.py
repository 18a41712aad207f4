"""Registered queries, one module per area."""

from importlib import import_module

AREAS = (
    "catalog",
    "scalars",
    "evaluation",
    "retrieval",
    "fusion",
    "rights",
    "profiles",
    "ledger",
    "operations",
    "plugins",
    "streams",
)


def load_all() -> None:
    for area in AREAS:
        import_module(f"evidlake.plans.{area}")
