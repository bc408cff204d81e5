"""Registry of queries (``REGISTRO``) and their DuckDB oracle SQL (``ORACULO``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import preparacion as P

REGISTRO: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACULO: dict[str, str] = {}


def consulta(nombre: str, oraculo: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``nombre`` with its oracle SQL (None: rows-only check)."""

    def deco(fn):
        if nombre in REGISTRO:
            raise ValueError(f"duplicate query key {nombre}")
        REGISTRO[nombre] = fn
        if oraculo is not None:
            ORACULO[nombre] = oraculo.strip()
        return fn

    return deco


def tablas(spark: SparkSession, sf_dir: str) -> P.Tablas:
    return P.cargar(spark, sf_dir)


def W(*vistas: str, extra: str = "") -> str:
    """``WITH`` list of the stand-in views (plus extra CTEs) for an oracle query."""
    base = P.ctes(*vistas)
    return base + (",\n" + extra.strip() if extra else "") + "\n"
