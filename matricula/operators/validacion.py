"""Request validation: rules become a reason column; valid rows have none.

Rules follow the server code: required means "not null and not ''" (D16), patterns anchor at
the true end of the text (JavaScript ``$``, written ``\\z`` for Java regex, D18).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import escalares as E

# The patterns of the registration form (server side).
PATRON_CEDULA = r"^\d{6,9}\z"
PATRON_DOCUMENTO = r"^[a-zA-Z0-9]{6,20}\z"
PATRON_CODPAIS = r"^\+\d{1,4}\z"
PATRON_TELEFONO = r"^\d{7,15}\z"

CAMPOS_REGISTRO = ["tipodoc", "doc", "nombre", "apellido", "codpais", "telefono", "email", "pais", "ciudad",
                   "capacitacion", "fechanac"]


def falta_alguno(*cols: str) -> Column:
    return reduce(lambda a, b: a | b, [E.vacio(c) for c in cols])


def _coincide(c: str, patron: str) -> Column:
    return F.coalesce(F.col(c).rlike(patron), F.lit(False))


def motivo_registro() -> Column:
    """P11-P14 in the server's order: required fields, document by type, country code, phone."""
    return (
        F.when(falta_alguno(*CAMPOS_REGISTRO), F.lit("faltan_datos"))
        .when((F.col("tipodoc") == "Ced") & ~_coincide("doc", PATRON_CEDULA), F.lit("cedula_invalida"))
        .when((F.col("tipodoc") != "Ced") & ~_coincide("doc", PATRON_DOCUMENTO), F.lit("documento_invalido"))
        .when(~_coincide("codpais", PATRON_CODPAIS), F.lit("codpais_invalido"))
        .when(~_coincide("telefono", PATRON_TELEFONO), F.lit("telefono_invalido"))
    )


def validar_solicitudes(sol: DataFrame) -> DataFrame:
    """Adds ``motivo`` (null when the request passes every rule)."""
    return sol.withColumn("motivo", motivo_registro())


def solicitudes_validas(sol: DataFrame) -> DataFrame:
    return validar_solicitudes(sol).where(F.col("motivo").isNull()).drop("motivo")


def solicitudes_rechazadas(sol: DataFrame) -> DataFrame:
    return validar_solicitudes(sol).where(F.col("motivo").isNotNull()).select("solicitud_id", "doc", "motivo")


def solicitudes_normalizadas(validas: DataFrame) -> DataFrame:
    """name casing and phone assembly the server applies before writing a person."""
    return validas.select(
        "solicitud_id",
        "tipodoc",
        "doc",
        E.primera_mayuscula("nombre").alias("nombre"),
        E.primera_mayuscula("apellido").alias("apellido"),
        E.telefono_completo("codpais", "telefono").alias("telefono"),
        "email",
        "pais",
        "ciudad",
        "fechanac",
        "capacitacion",
        "recibido_en",
    )


def entrada_de_pagina(df: DataFrame, recortar: tuple[str, ...] = ("cedula", "email"), sin_ceros: tuple[str, ...] = ("telefono",)) -> DataFrame:
    """what the page does to its fields before it sends them: some are trimmed, phones lose their leading zeros."""
    return df.withColumns({c: E.recortar(c) for c in recortar} | {c: E.sin_ceros_iniciales(c) for c in sin_ceros})


def ofertas_validas(borradores: DataFrame) -> DataFrame:
    """Offer drafts with every field present and start not after end (equal passes, and an
    unparsable date compares false, so it passes too: D15). Adds ``motivo`` and
    ``fecha_ilegible`` (quarantine flag for dates that do not parse)."""
    ini = F.col("fecha_inicio").cast("string").try_cast("date")
    fin = F.col("fecha_fin").cast("string").try_cast("date")
    motivo = (
        F.when(falta_alguno("capofcapcodigo", "fecha_inicio", "fecha_fin", "cupos"), F.lit("faltan_datos"))
        .when(F.coalesce(ini > fin, F.lit(False)), F.lit("fechas_invertidas"))
    )
    return borradores.withColumn("motivo", motivo).withColumn("fecha_ilegible", ini.isNull() | fin.isNull())


def pagos_validos(pagos: DataFrame, lote: bool = False) -> DataFrame:
    """A single payment needs code, holder name, reference and a receipt; a lot payment
    also needs the holder surname. Adds ``motivo``."""
    campos = ["titular_nombre", "titular_apellido", "referencia"] if lote else ["inscodigo", "titular_nombre", "referencia"]
    if lote:
        campos = ["oferta"] + campos
    sin_comprobante = F.coalesce(F.col("tiene_comprobante") != 1, F.lit(True))
    return pagos.withColumn(
        "motivo", F.when(falta_alguno(*campos) | sin_comprobante, F.lit("faltan_datos"))
    )


def lotes_completos(filas: DataFrame) -> DataFrame:
    """A lot is complete when every row has document, name, e-mail, birth date and phone
    (trimmed, non-empty); one bad row blocks the whole lot. One row per lot."""
    def lleno(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c)) != "", F.lit(False))

    fila_ok = lleno("doc") & lleno("nombre") & lleno("email") & lleno("fechanac") & lleno("telefono")
    return filas.groupBy("lote_id").agg(
        F.count(F.lit(1)).alias("filas"),
        F.bool_and(fila_ok).alias("completo"),
        F.sum(F.when(fila_ok, 0).otherwise(1)).alias("filas_incompletas"),
    )
