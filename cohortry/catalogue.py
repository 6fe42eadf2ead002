"""Every query of the cohort operators, by name, with equivalent DuckDB SQL."""

from __future__ import annotations

from cohortry.plans import bands, cohorts, composites, images, imports, inference, networks, proportions, stability, trees, verbs, volumes

_REGISTERS = [verbs.register, images.register, inference.register, trees.register, networks.register, cohorts.register, composites.register, proportions.register, stability.register, volumes.register, bands.register, imports.register]

QUERIES = {name: f for r in _REGISTERS for name, f in r.queries.items()}
ORACLES = {name: sql for r in _REGISTERS for name, sql in r.oracles.items()}
