"""Domain tables at rest (S1, S4-S6, S7) as plain partitioned Parquet.

A table is the folder ``<raiz>/<table>/cubeta=<n>/lote=<batch>``: ``cubeta`` is the hash of the row's key
modulo a fixed number, ``lote`` the batch that appended the row (``base`` for the first load).

* An append writes the batch's rows to partitions of their own, with dynamic partition overwrite: a batch that
  is replayed after a failure replaces just those, so its rows are there once.
* A change reads and writes anew only the partitions that hold a row it touches; all other files stay as they
  are. Deleted rows stay in their partition with ``borrada`` set, so no partition becomes empty and is left behind
  by the overwrite; ``compactar`` writes a copy without them.
* Logs (results, outbox, audit rows) are Parquet partitioned by batch, read with partition pruning.

Each table publishes by itself. A batch over several tables is completed by replay: a job first writes its decisions
to a log (``decidir``), one partition and so one rename, and then applies them to the tables. Run again after a failure,
it finds the decisions there and applies the same ones; every step gives the same rows however often it runs. One job
writes to a folder at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.salidas import COLUMNAS_AUDITORIA, COLUMNAS_OUTBOX
from .esquemas import TABLAS
from .lectores import conformar
from .preparacion import Tablas, desde_dataframes

BASE = "base"
#: Key by which the rows of a table are dealt out.
CLAVES = {
    "persona": ["perdoc"], "capacitacion": ["capcodigo"], "capacitacion_oferta": ["capofcodigo"], "contacto_empresa": ["id_contacto"],
    "inscripcion": ["inscodigo"], "persona_capacitacion": ["pcap_perdoc", "pcap_oferta"], "pago_reportado": ["pago_inscodigo"],
    "token_otp": ["id_otp"],
}
CUBETAS = 32
_PARTICION = ["cubeta", "lote"]
_LOGS = {
    "auditoria": T.StructType([T.StructField(c, T.TimestampType() if c == "ts" else T.StringType()) for c in COLUMNAS_AUDITORIA]),
    "outbox": T.StructType([T.StructField(c, T.LongType() if c == "cantidad" else T.StringType()) for c in COLUMNAS_OUTBOX]),
}


def _comprobar(lote: str) -> None:
    if lote == BASE or not re.fullmatch(r"[A-Za-z0-9_-]+", lote):
        raise ValueError(f"{lote!r} cannot name a batch")


def _ajustes(raiz: str) -> str:
    return f"{raiz}/_ajustes"


def cubetas(spark: SparkSession, raiz: str) -> int:
    """Number of key hashes of the tables under ``raiz``, fixed when they are created."""
    return spark.read.schema("cubetas int").parquet(_ajustes(raiz)).first()[0]


def _cubeta(cols: list[str], n: int):
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def _escribir(filas: DataFrame, ruta: str, por: list[str]) -> None:
    """Write whole partitions; those without a row in ``filas`` stay as they are. Rebalanced, so that a large
    partition is several files and a small one is one."""
    filas.hint("rebalance", *[F.col(c) for c in por]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*por).parquet(ruta)


def crear(spark: SparkSession, raiz: str, tablas: dict[str, DataFrame], n: int = CUBETAS) -> None:
    """First load of all tables (one not given is empty) and empty logs. Replaces what a failed load left."""
    spark.createDataFrame([(n,)], "cubetas int").write.mode("overwrite").parquet(_ajustes(raiz))
    for nombre, esquema in TABLAS.items():
        filas = conformar(tablas[nombre], esquema) if nombre in tablas else spark.createDataFrame([], esquema)
        _escribir(_nuevas(filas, nombre, BASE, n), f"{raiz}/{nombre}", _PARTICION)
    for nombre, esquema in _LOGS.items():
        anotar(raiz, BASE, nombre, spark.createDataFrame([], esquema))


def _nuevas(filas: DataFrame, nombre: str, lote: str, n: int) -> DataFrame:
    return filas.select("*", F.lit(False).alias("borrada"), _cubeta(CLAVES[nombre], n).alias("cubeta"), F.lit(lote).alias("lote"))


def _todas(spark: SparkSession, raiz: str, nombre: str) -> DataFrame:
    """Every row with ``borrada``, ``cubeta`` and ``lote``."""
    esquema = T.StructType([
        *TABLAS[nombre].fields, T.StructField("borrada", T.BooleanType()), T.StructField("cubeta", T.IntegerType()),
        T.StructField("lote", T.StringType())])
    return spark.read.schema(esquema).parquet(f"{raiz}/{nombre}")


def leer(spark: SparkSession, raiz: str, nombre: str, sin_lote: str | None = None) -> DataFrame:
    """The table's rows; without those that the batch ``sin_lote`` appended, as they were before it."""
    df = _todas(spark, raiz, nombre).where("NOT borrada")
    if sin_lote is not None:
        df = df.where(F.col("lote") != sin_lote)
    return df.select(*TABLAS[nombre].names)


def abrir(spark: SparkSession, raiz: str, sin_lote: str | None = None) -> Tablas:
    """All tables, as ``leer``."""
    return desde_dataframes(spark, {n: leer(spark, raiz, n, sin_lote) for n in TABLAS})


def agregar(spark: SparkSession, raiz: str, lote: str, nombre: str, filas: DataFrame) -> None:
    """The batch's new rows, in partitions of their own."""
    _comprobar(lote)
    filas = _nuevas(conformar(filas, TABLAS[nombre]), nombre, lote, cubetas(spark, raiz))
    _escribir(filas, f"{raiz}/{nombre}", _PARTICION)


def afectadas(spark: SparkSession, raiz: str, nombre: str, claves: DataFrame, por: list[str] | None = None, sin_lote: str | None = None) -> DataFrame:
    """All rows (with ``borrada`` and the partition) of the partitions that hold a row whose columns ``por`` (the
    key by default) are in ``claves``. By the key, only the partitions of its hashes are read to find them."""
    por = por or CLAVES[nombre]
    claves = claves.select(*por).distinct()
    todas = _todas(spark, raiz, nombre)
    if sin_lote is not None:
        todas = todas.where(F.col("lote") != sin_lote)
    if por == CLAVES[nombre]:
        n = cubetas(spark, raiz)
        hallar = [r[0] for r in claves.select(_cubeta(por, n)).distinct().collect()]  # at most n numbers
        todas = todas.where(F.col("cubeta").isin(hallar))
    partes = todas.where("NOT borrada").join(claves, por, "left_semi").select(*_PARTICION).distinct()
    return todas.join(partes, _PARTICION, "left_semi")


def reescribir(raiz: str, nombre: str, filas: DataFrame) -> None:
    """Write back whole partitions as ``afectadas`` gave them, with changed values or ``borrada`` set."""
    columnas = [*TABLAS[nombre].names, "borrada", *_PARTICION]
    _escribir(filas.select(*columnas), f"{raiz}/{nombre}", _PARTICION)


def borrar(filas: DataFrame, claves: DataFrame, por: list[str]) -> DataFrame:
    """``filas`` (as ``afectadas``) with ``borrada`` set where the columns ``por`` are in ``claves``."""
    marca = claves.select(*por).distinct().withColumn("__b", F.lit(True))
    return filas.join(marca, por, "left").withColumn("borrada", F.col("borrada") | F.coalesce("__b", F.lit(False))).select(*filas.columns)


def anotar(raiz: str, lote: str, nombre: str, filas: DataFrame) -> None:
    """The batch's rows of a log, in a partition of their own."""
    _escribir(filas.withColumn("lote", F.lit(lote)), f"{raiz}/_registro/{nombre}", ["lote"])


def decidir(spark: SparkSession, raiz: str, lote: str, nombre: str, calcular: Callable[[], DataFrame]) -> DataFrame:
    """The batch's decisions: those already in the log ``nombre``, or else those of ``calcular``, written there first."""
    _comprobar(lote)
    ruta = f"{raiz}/_registro/{nombre}/lote={lote}"
    try:
        return spark.read.parquet(ruta)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    df = calcular()
    anotar(raiz, lote, nombre, df)
    try:
        return spark.read.schema(df.schema).parquet(ruta)
    except AnalysisException as e:  # no rows, no partition
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], df.schema)


def leer_registro(spark: SparkSession, raiz: str, nombre: str) -> DataFrame:
    """A log's rows with their batch ``lote``, a partition column. ``auditoria`` and ``outbox`` exist from the
    start; a job's results (``resultados/<job>``) once it has written rows."""
    lector = spark.read
    if nombre in _LOGS:
        lector = lector.schema(T.StructType([*_LOGS[nombre].fields, T.StructField("lote", T.StringType())]))
    return lector.parquet(f"{raiz}/_registro/{nombre}")


def compactar(spark: SparkSession, raiz: str, destino: str, n: int | None = None) -> None:
    """The live rows of all tables as a first load under ``destino``, and the logs: one partition a hash
    again, without deleted rows. Readers move over to the new folder."""
    crear(spark, destino, dict(abrir(spark, raiz)), n or cubetas(spark, raiz))
    for nombre in _LOGS:
        _escribir(leer_registro(spark, raiz, nombre), f"{destino}/_registro/{nombre}", ["lote"])
