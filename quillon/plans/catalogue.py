"""Operators by name: what ``dispatch`` runs on a corpus, with their descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..queries.registry import QUERIES
from ..sources.tables import Corpus


class UnknownOperator(KeyError):
    """No operator has this name."""


def names() -> list[str]:
    from .. import queries  # noqa: F401  registers them

    return sorted(QUERIES)


def dispatch(name: str, corpus: Corpus) -> DataFrame:
    """Run a named operator."""
    if name not in names():
        raise UnknownOperator(name)
    return QUERIES[name](corpus.spark, corpus.sf_dir)
