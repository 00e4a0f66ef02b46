"""Assembles the registered queries from every ``q_*`` module."""

from __future__ import annotations

import importlib

from cadence.plans import registry

_MODULES = [
    "cadence.plans.q_runs",
    "cadence.plans.q_targets",
    "cadence.plans.q_clean",
    "cadence.plans.q_profile",
    "cadence.plans.q_lookup",
    "cadence.plans.q_behaviour",
    "cadence.plans.q_text",
    "cadence.plans.q_ml",
    "cadence.plans.q_stream",
    "cadence.plans.q_checks",
]

_loaded = False


def _load():
    global _loaded
    if not _loaded:
        for m in _MODULES:
            importlib.import_module(m)
        _loaded = True


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLE)
