"""Collects the query registry from every catalog module."""

from __future__ import annotations


def load_registry() -> dict:
    from ledgerguard.plans import catalog, catalog_governance, catalog_pii, catalog_streaming  # noqa: F401
    return dict(catalog.REGISTRY)
