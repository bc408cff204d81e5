"""Tables and change sets as plain Parquet folders (no batches): written whole, read with their schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import lectores
from .esquemas import TABLAS
from .preparacion import Tablas, desde_dataframes


def materializar(tablas: dict[str, DataFrame], nombres: list[str], destino: str) -> None:
    """Write the named tables as Parquet under ``destino/<name>`` (overwrite)."""
    for n in nombres:
        tablas[n].write.mode("overwrite").parquet(f"{destino}/{n}")


def abrir(spark: SparkSession, destino: str, nombres: list[str] | None = None) -> Tablas:
    """Scans of tables written by ``materializar``: typed (``leer_tabla``) for domain tables,
    the file schema for change sets."""
    return desde_dataframes(spark, {
        n: lectores.leer_tabla(spark, f"{destino}/{n}", n) if n in TABLAS else spark.read.parquet(f"{destino}/{n}")
        for n in nombres or TABLAS
    })


#: Bucket and sort column of the large tables: enrolments lie with their people, payment reports by enrolment.
CUBOS = {"inscripcion": "ins_perdoc", "persona": "perdoc", "pago_reportado": "pago_inscodigo"}


def en_cubos(spark: SparkSession, tablas: dict[str, DataFrame], destino: str, n: int) -> Tablas:
    """Write all domain tables under ``destino``, the large ones as bucketed and sorted tables of the session's catalogue (under
    names of their own), and read them back. The grid then joins people with enrolments as they lie, and payment
    reports as they lie with the enrolments shuffled once; ``n`` should be the number of shuffle partitions."""
    propio, out = uuid.uuid4().hex[:12], {}
    for nombre, esquema in TABLAS.items():
        filas = lectores.conformar(tablas[nombre], esquema)
        if nombre not in CUBOS:
            filas.write.mode("overwrite").parquet(f"{destino}/{nombre}")
            out[nombre] = lectores.leer_tabla(spark, f"{destino}/{nombre}", nombre)
            continue
        tabla, clave = f"{nombre}_{propio}", CUBOS[nombre]
        filas.repartition(n, clave).write.format("parquet").bucketBy(n, clave).sortBy(clave).option("path", f"{destino}/{nombre}").saveAsTable(tabla)
        out[nombre] = spark.table(tabla)
    return desde_dataframes(spark, out)
