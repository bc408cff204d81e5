"""Sources: typed table scans, JSON change sets and nested company lots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import escalares as E
from .esquemas import CAMBIOS, TABLAS


def conformar(df: DataFrame, esquema: T.StructType) -> DataFrame:
    """Project and cast to the declared schema (missing columns become typed nulls)."""
    presentes = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in presentes else F.lit(None)).cast(f.dataType).alias(f.name) for f in esquema.fields
    ])


def leer_tabla(spark: SparkSession, ruta: str | list[str] | None, nombre: str, formato: str = "parquet", **opciones) -> DataFrame:
    """One domain table. Parquet (default) or any DataFrameReader format such as ``jdbc``
    (``leer_tabla(spark, None, 'persona', 'jdbc', url=..., dbtable='persona')``), conformed to the
    table's schema. Column pruning and filters reach the scan through Catalyst."""
    lector = spark.read.format(formato).options(**opciones)
    df = lector.load(ruta) if ruta is not None else lector.load()
    return conformar(df, TABLAS[nombre])


# ISO-8601 with microseconds; a time without an offset is read in the session time zone (UTC).
FORMATO_TS_JSON = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"


_COMO_TEXTO = (T.LongType, T.IntegerType, T.TimestampType, T.TimestampNTZType)


def _crudo(lector, ruta: str, esquema: T.StructType) -> DataFrame:
    """JSON lines by ``lector`` (``spark.read`` or ``spark.readStream``) with numbers and times as text, and ``linea_mala``,
    the line itself where it is no JSON record."""
    campos = [T.StructField(f.name, T.StringType() if isinstance(f.dataType, _COMO_TEXTO) else f.dataType) for f in esquema.fields]
    return lector.schema(T.StructType([*campos, T.StructField("linea_mala", T.StringType())])) \
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "linea_mala").json(ruta)


def _interpretar(crudo: DataFrame, esquema: T.StructType) -> DataFrame:
    """Rows of ``_crudo`` in the declared types: ids as the application coerces them (``entero_js``), so a page's text id is an
    id. ``linea_mala`` also holds the record where an id or time is given but not readable (those are null)."""
    columnas, ilegible = [], F.lit(False)
    for f in esquema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.LongType, T.IntegerType)):
            v = E.entero_js(c).try_cast(f.dataType)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            v = F.try_to_timestamp(c, F.lit(FORMATO_TS_JSON)).cast(f.dataType)
        else:
            v = c
        if isinstance(f.dataType, _COMO_TEXTO):
            ilegible = ilegible | (c.isNotNull() & (c != "") & v.isNull())
        columnas.append(v.alias(f.name))
    registro = F.to_json(F.struct(*[f.name for f in esquema.fields]))
    return crudo.select(*columnas, F.coalesce("linea_mala", F.when(ilegible, registro)).alias("linea_mala"))


def _leer_json(spark: SparkSession, ruta: str, esquema: T.StructType) -> DataFrame:
    """JSON lines with an explicit schema, see ``_interpretar``."""
    return _interpretar(_crudo(spark.read, ruta, esquema), esquema)


def leer_flujo(spark: SparkSession, ruta: str, cambio: str, archivos_por_lote: int | None = None) -> DataFrame:
    """S2 as a stream: JSON lines of a change set as they arrive in ``ruta``, read as in a batch. ``linea_mala`` stays, see
    ``registros`` and ``malas``."""
    lector = spark.readStream
    if archivos_por_lote:
        lector = lector.option("maxFilesPerTrigger", archivos_por_lote)
    return _interpretar(_crudo(lector, ruta, CAMBIOS[cambio]), CAMBIOS[cambio])


def registros(df: DataFrame, cambio: str) -> DataFrame:
    """The requests among rows that carry ``linea_mala``."""
    return df.where(_hay_registro(CAMBIOS[cambio])).drop("linea_mala")


def malas(df: DataFrame, cambio: str) -> DataFrame:
    """Quarantine of rows that carry ``linea_mala``: lines that are no record, or that give an unreadable id or time."""
    motivo = F.when(_hay_registro(CAMBIOS[cambio]), "valor_ilegible").otherwise("no_es_registro")
    return df.where(F.col("linea_mala").isNotNull()).select(F.col("linea_mala").alias("linea"), motivo.alias("motivo"))


def leer_solicitudes(spark: SparkSession, ruta: str, con_malas: bool = False) -> DataFrame:
    """Registration requests as JSON lines with the explicit request schema. Lines that are no JSON
    record hold no request and go to ``lineas_malas``; with ``con_malas`` they stay, in column ``linea_mala``."""
    df = _leer_json(spark, ruta, CAMBIOS["solicitud_registro"])
    return df if con_malas else df.where(_hay_registro(CAMBIOS["solicitud_registro"])).drop("linea_mala")


def _hay_registro(esquema: T.StructType):
    todo = F.lit(True)
    for f in esquema.fields:
        todo = todo & F.col(f.name).isNull()
    return ~todo


def lineas_malas(spark: SparkSession, ruta: str, cambio: str) -> DataFrame:
    """Quarantine: lines of a change set that are no record, or that give an unreadable id or time."""
    return malas(_leer_json(spark, ruta, CAMBIOS[cambio]), cambio)


def leer_cambio(spark: SparkSession, ruta: str, cambio: str) -> DataFrame:
    """Any change set as JSON lines, with its explicit schema (never inferred)."""
    return registros(_leer_json(spark, ruta, CAMBIOS[cambio]), cambio)


def escribir_json(df: DataFrame, ruta: str) -> None:
    """JSON lines sink for change sets, keeping microseconds (the default keeps milliseconds)."""
    df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") \
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(ruta)


def leer_lotes(spark: SparkSession, ruta: str) -> DataFrame:
    """S3: nested lot records (one JSON object per lot with an ``empleados`` array)."""
    return leer_cambio(spark, ruta, "lote")


def revisar_lotes(lotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3 with its checks (P17): the employee rows (``lote_explode``) of the lots that may be admitted, and the quarantine
    (``lote_id, posicion, motivo``). A lot without a readable id, company or offer (``id_ilegible``) or without employees
    (``sin_empleados``) is refused as a whole (``posicion`` null); a lot with an employee that lacks a required field is refused
    too, with a row for each such employee (``empleado_incompleto``). Fields are trimmed as the page does (F7)."""
    con_ids = F.col("lote_id").isNotNull() & F.col("empresa_id").isNotNull() & F.col("oferta").isNotNull()
    hay = F.coalesce(F.size("empleados"), F.lit(0)) > 0
    motivo = F.when(~con_ids, "id_ilegible").when(~hay, "sin_empleados")
    enteros = lotes.withColumn("motivo", motivo)
    filas = lote_explode(enteros.where(F.col("motivo").isNull()))
    filas = filas.withColumns({c: E.recortar(c) for c in ("doc", "nombre", "apellido", "telefono", "email", "fechanac", "ciudad")})
    lleno = F.lit(True)
    for c in ("doc", "nombre", "email", "fechanac", "telefono"):
        lleno = lleno & ~E.vacio(c)
    malas_ = filas.where(~lleno).select("lote_id", "posicion", F.lit("empleado_incompleto").alias("motivo"))
    buenas = filas.join(malas_.select("lote_id"), "lote_id", "left_anti")
    de_lote = enteros.where(F.col("motivo").isNotNull()).select("lote_id", F.lit(None).cast("int").alias("posicion"), "motivo")
    return buenas, de_lote.unionByName(malas_)


def lote_explode(lotes: DataFrame) -> DataFrame:
    """S3: flatten nested lots to one row per employee with its position in the list. A lot
    with an empty list yields no rows: the application refuses it and changes nothing."""
    envio = [c for c in ("sesion_email", "en") if c in lotes.columns]  # who sent it and when, if the record says so
    return lotes.select(
        "lote_id", "empresa_id", "oferta", *envio, F.posexplode("empleados").alias("posicion", "e")
    ).select("lote_id", "empresa_id", "oferta", *envio, "posicion", "e.*")


def anidar_lotes(filas: DataFrame) -> DataFrame:
    """Inverse of ``lote_explode`` for flat lot rows (``lote_fila``): one record per lot, the
    employee array in row order. A lot is one request body, which the application's JSON body
    parser caps (100 KB by default), so each array is bounded by that request size."""
    emp = F.struct(*[F.col(c) for c in ["fila", "tipodoc", "doc", "nombre", "apellido", "telefono", "email",
                                          "fechanac", "pais", "ciudad"]])
    return filas.groupBy("lote_id", "empresa_id", "oferta").agg(
        F.array_sort(F.collect_list(emp)).alias("empleados")
    )
