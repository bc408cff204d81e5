"""Registration requests as a stream.

Requests arrive as JSON lines in a folder and are read as in a batch: ids as text, times, and lines that are no
record (``lectores.leer_flujo``). Each micro-batch is one run of the job ``trabajos.registro`` over the tables at rest,
under a batch name made from the epoch: a replayed epoch finds its decisions and partitions there and writes
the same rows again, so the tables change exactly once per epoch whatever other jobs did since. Lines that are no
record, or give an unreadable id or time, go to the log ``lineas_malas``. Seats are the tables' state, so no streaming
state store is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans import trabajos
from ..sources import deposito, lectores

CAMBIO = "solicitud_registro"
#: Log of the quarantined lines.
MALAS = "lineas_malas"


def nombre_lote(flujo: str, epoch: int) -> str:
    return f"{flujo}-{epoch:012d}"


def procesar_lote(spark: SparkSession, raiz: str, lote: DataFrame, epoch: int, flujo: str = "registro") -> None:
    """One micro-batch of ``lectores.leer_flujo``: quarantine, then admit and write (idempotent per epoch)."""
    nombre = nombre_lote(flujo, epoch)
    lote = lote.persist()
    try:
        deposito.anotar(raiz, nombre, MALAS, lectores.malas(lote, CAMBIO))
        trabajos.registro(spark, raiz, lectores.registros(lote, CAMBIO), nombre)
    finally:
        lote.unpersist()


def iniciar(spark: SparkSession, origen: str, raiz: str, checkpoint: str, hasta_agotar: bool = True,
            archivos_por_lote: int | None = None, flujo: str = "registro"):
    """Start the stream; with ``hasta_agotar`` it processes what is there and stops. Two streams into one folder of tables
    need names (``flujo``) of their own."""
    escritor = lectores.leer_flujo(spark, origen, CAMBIO, archivos_por_lote).writeStream.foreachBatch(
        lambda df, epoch: procesar_lote(spark, raiz, df, epoch, flujo)
    ).option("checkpointLocation", checkpoint)
    escritor = escritor.trigger(availableNow=True) if hasta_agotar else escritor.trigger(processingTime="10 seconds")
    return escritor.start()
