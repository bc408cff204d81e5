"""Small hand-built tables in the domain schemas for edge-case and model tests."""

from __future__ import annotations

import datetime as dt

from matricula.sources.esquemas import CAMBIOS, TABLAS
from matricula.sources.preparacion import desde_dataframes


def df(spark, nombre, filas, esquema=None):
    return spark.createDataFrame(filas, esquema or TABLAS.get(nombre) or CAMBIOS[nombre])


def tablas(spark, **filas):
    """Domain tables from row lists; tables not given are empty."""
    out = {}
    for n, esquema in TABLAS.items():
        out[n] = spark.createDataFrame(filas.get(n, []), esquema)
    return desde_dataframes(spark, out)


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def oferta(cod, cupos, estatus=1, bloq=0, curso=1):
    return (cod, curso, dt.date(2024, 1, 1), dt.date(2024, 2, 1), cupos, estatus, bloq)


def inscripcion(cod, doc, of, empresa=None, estado="pendiente", fecha="2024-01-01 00:00:00"):
    return (cod, doc, of, empresa, estado, ts(fecha))


def persona(doc, nombre="Ana", tipo="Ced"):
    return (tipo, doc, nombre, "Perez", dt.date(1990, 1, 1), "+58 4140000000", f"{doc}@x.org", "VE", "Caracas")


def solicitud(sid, doc, of, en, tipodoc="Ced", nombre="ana", codpais="+58", telefono="4141234567", fechanac="1990-01-01"):
    return (sid, tipodoc, doc, nombre, "perez", codpais, telefono, f"{doc}@x.org", "VE", "Caracas", fechanac, of, ts(en))
