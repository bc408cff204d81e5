"""Running counts and numbering in arrival order that do not put a hot key in one task.

``Window.partitionBy(k).orderBy(t)`` sends every row of key ``k`` to one task; if one offer
holds a third of all requests, that task holds a third of the data. Instead the rows are
range-partitioned on (key, order) into blocks, so a hot key spans many blocks; each block's
total is computed, a prefix over the (few) block totals of each key gives the block's offset,
and the running value inside a block is a window over that block only.

Block ids come from ``spark_partition_id()`` after the range shuffle, so the blocked rows are
checkpointed (reliable checkpoint in ``spark.checkpoint.dir``) before they are used twice: a
recomputed task then reads the same block assignment instead of re-sampling range bounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BLQ, _TOT, _OFF = "__blq", "__tot", "__off"


def _bloques(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def suma_acumulada(
    df: DataFrame, particion: list[str], orden: list[str], valor: str, salida: str, bloques: int | None = None
) -> DataFrame:
    """Adds ``salida`` = sum of ``valor`` over rows of the same ``particion`` up to and including
    this row in ``orden`` (which must be a total order, e.g. end with a unique id)."""
    n = _bloques(df, bloques)
    # The range shuffle samples its input before the checkpoint job reads it: keep the input
    # cached just for these two passes so upstream joins run once.
    entrada = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        con_bloque = entrada.repartitionByRange(n, *[F.col(c) for c in particion + orden]).withColumn(
            _BLQ, F.spark_partition_id()
        ).checkpoint(eager=True)
    finally:
        entrada.unpersist()
    totales = con_bloque.groupBy(*particion, _BLQ).agg(F.sum(valor).alias(_TOT))
    previos = Window.partitionBy(*particion).orderBy(_BLQ).rowsBetween(Window.unboundedPreceding, -1)
    desplaz = totales.select(*particion, _BLQ, F.coalesce(F.sum(_TOT).over(previos), F.lit(0)).alias(_OFF))
    cond = reduce(
        lambda a, b: a & b,
        [con_bloque[c].eqNullSafe(desplaz[c]) for c in particion] + [con_bloque[_BLQ] == desplaz[_BLQ]],
    )
    unido = con_bloque.join(desplaz, cond, "inner").select(con_bloque["*"], desplaz[_OFF])
    dentro = Window.partitionBy(*particion, _BLQ).orderBy(*orden).rowsBetween(Window.unboundedPreceding, 0)
    return unido.withColumn(salida, F.col(_OFF) + F.sum(valor).over(dentro)).drop(_BLQ, _OFF)


def mayor_valor(df: DataFrame, col: str) -> int:
    """Largest value of an id column (0 when empty): one aggregate, read as a scalar so new ids
    can continue after it. Works in any session (also inside ``foreachBatch``)."""
    v = df.agg(F.max(col)).first()[0]
    return int(v) if v is not None else 0


def numerar(df: DataFrame, orden: list[str], salida: str, particion: list[str] | None = None, bloques: int | None = None) -> DataFrame:
    """Adds ``salida`` = 1, 2, 3... in ``orden`` (per ``particion`` if given), without a
    single-partition window."""
    uno = "__uno"
    r = suma_acumulada(df.withColumn(uno, F.lit(1).cast("long")), particion or [], orden, uno, salida, bloques)
    return r.drop(uno)
