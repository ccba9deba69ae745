"""The named queries over the driver's tables."""

from __future__ import annotations

from importlib import import_module

from sparklode.plans.registry import Query

MODULES = ("activity", "catalogue", "texts", "similar", "snapshots", "rules", "marks", "records", "neighbours", "live", "concepts", "files", "repair", "audits")


def queries() -> dict[str, Query]:
    return {n: q for m in MODULES for n, q in import_module(f"sparklode.plans.{m}").register.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for m in MODULES for n, q in import_module(f"sparklode.plans.{m}").register.oracles.items()}
