"""Registered queries of the engine."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """Queries and their SQL by name; importing the modules registers them."""
    from clausemill.plans import act_text, acts, checks, context, core, dataset, evidence, identity, inputs, judging, ledger, more, pages, registry, stores, verdicts, worksheet  # noqa: F401

    return registry.QUERIES, registry.ORACLES
