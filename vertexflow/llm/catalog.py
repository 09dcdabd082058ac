"""Registration of the corpus queries."""

from __future__ import annotations

import corpus_pipeline

from . import queries as q
from . import sql


def queries() -> dict:
    return {name: f for name, f in vars(q).items() if name.startswith("op")} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
