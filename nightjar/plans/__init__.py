"""Registered queries: each module registers its own at import."""

from nightjar.plans import access, arrivals, cloud, conn, coverage, cube, events, findings, inventory, ledger, lists, mining, names, sources, tokens, zeek  # noqa: F401
