"""All core queries by name."""

from __future__ import annotations

from auditloom.plans import audit, behaviour, problems, streams, text

MODULES = (audit, text, behaviour, streams, problems)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}
