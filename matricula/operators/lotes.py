"""Company lot admission, all or nothing.

Sequential semantics (one lot at a time in arrival order, ``lote_id``): a lot needs
``size - |distinct lot documents already enrolled on the offer|`` seats (a document repeated in
the list counts twice, D10). If that is > 0 the offer must exist, not be blocked and have at
least that many seats left; otherwise the lot is refused and leaves no trace. A lot needing 0
is accepted without any check. An accepted lot enrols each of its documents not yet enrolled
(once), upserts every employee (last write wins, ``pertipodoc`` kept, D8) and writes the
academic rows.

A refused lot may be followed by a smaller one that fits, so no window formula exists for the whole
batch. Lots whose decision does not depend on earlier lots are settled at once:

* with ``d = size - already enrolled before the batch`` and ``rest0`` the seats left before the
  batch, at most ``max(rest0, 0)`` documents can be admitted on the offer in the whole batch
  (each takes a seat), so a lot's need lies in ``[d - max(rest0, 0), d]``;
* ``d <= 0``: accepted, enrols nobody; missing offer: ``no_existe``; blocked offer: ``pausada``
  (nothing is admitted there, so its need is ``d``); ``d > max(rest0, 0)``: ``sin_cupos`` (once ``a`` documents
  were admitted it needs at least ``d - a`` of the ``rest0 - a`` seats left).

The other candidates (``0 < d <= rest0``) keep one compact row each, and one row per new document that
other candidates of the offer list too. Offers with more than ``tam_tramo`` candidates are settled in
set-based rounds (``_ronda``), all offers at once: a round supposes that lots below the largest power of two
not above the seats left are accepted and larger ones refused, and takes everybody's exact need and
seats under that by prefix sums and the first lot of each document. The first lot that contradicts it is
decided by its exact numbers too; all lots up to it are settled. Then seats and documents are updated, and
lots that need more than the seats left are refused for good, as each admission takes a seat but spares at
most one. A small lot that is refused leaves fewer seats than that power, and a large one that is accepted
takes at least so many (less only where its list repeats documents), so the power halves every round:
the rounds follow the logarithm of the seats, not the lots. What is left of an offer, ``tam_tramo`` lots at
most, is scanned by one pandas group with its seats; the length never alters results.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .admision import estado_ofertas
from .consultas import pares_inscritos
from .secuencia import mayor_valor, numerar, suma_acumulada

TAM_TRAMO = 20_000

# The per-offer scan runs in Python workers; ship this module's functions by value so workers
# need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ESQUEMA_SALIDA = "lote_id long, motivo string, nuevos long"


def _docs_con_e0(t, filas: DataFrame) -> DataFrame:
    """Distinct (lot, offer, document) rows flagged ``en_e0`` when enrolled before the batch."""
    ya = pares_inscritos(t, filas).withColumn("en_e0", F.lit(True))
    return filas.select("lote_id", "oferta", "doc").distinct().join(ya, ["doc", "oferta"], "left") \
        .withColumn("en_e0", F.coalesce(F.col("en_e0"), F.lit(False)))


def clasificar_lotes(t, filas: DataFrame, docs: DataFrame) -> DataFrame:
    """Per lot: size, documents already enrolled (A6), offer state, and the decision when it does
    not depend on earlier lots of the batch (``motivo`` null: the lot is a candidate). ``docs``: see ``_docs_con_e0``."""
    ya0 = docs.groupBy("lote_id").agg(F.sum(F.col("en_e0").cast("long")).alias("ya0"))
    tam = filas.groupBy("lote_id", "oferta", "empresa_id").agg(F.count(F.lit(1)).alias("filas"))
    est = estado_ofertas(t, filas)
    x = tam.join(ya0, "lote_id", "inner").join(est, "oferta", "left").select(
        "lote_id", "oferta", "empresa_id", "filas", "ya0",
        F.col("rest").isNotNull().alias("existe"),
        F.coalesce(F.col("bloqueada"), F.lit(False)).alias("bloqueada"),
        F.coalesce(F.col("rest"), F.lit(0)).cast("long").alias("rest0"),
    )
    d = F.col("filas") - F.col("ya0")
    motivo = (
        F.when(d <= 0, F.lit("ok"))
        .when(~F.col("existe"), F.lit("no_existe"))
        .when(F.col("bloqueada"), F.lit("pausada"))
        .when(d > F.greatest(F.col("rest0"), F.lit(0)), F.lit("sin_cupos"))
    )
    return x.withColumn("motivo", motivo)


def _candidatos(docs: DataFrame, clases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidate lots (``oferta, lote_id, rest, fijo, excl, comunes``) and the documents they share (``oferta, doc, lote_id``).
    ``excl``: new documents no other candidate of the offer lists; ``fijo``: those and the repeated lines, needed in any case;
    ``comunes``: new documents that other candidates list too. The need is ``fijo + comunes`` while none of them is admitted."""
    cand = clases.where(F.col("motivo").isNull()).select("lote_id", "oferta", "filas", "ya0", "rest0")
    nuevos = docs.where(~F.col("en_e0")).join(cand.select("lote_id"), "lote_id", "left_semi").select("oferta", "doc", "lote_id")
    veces = nuevos.groupBy("oferta", "doc").agg(F.count(F.lit(1)).alias("veces"))
    compartidos = nuevos.join(veces.where("veces > 1"), ["oferta", "doc"], "left_semi")
    n_nuevos = nuevos.groupBy("lote_id").agg(F.count(F.lit(1)).alias("n"))
    n_comunes = compartidos.groupBy("lote_id").agg(F.count(F.lit(1)).alias("comunes"))
    n, comunes = F.coalesce("n", F.lit(0)), F.coalesce("comunes", F.lit(0))
    lotes = cand.join(n_nuevos, "lote_id", "left").join(n_comunes, "lote_id", "left").select(
        "oferta", "lote_id", F.col("rest0").alias("rest"), (F.col("filas") - F.col("ya0") - comunes).alias("fijo"),
        (n - comunes).alias("excl"), comunes.alias("comunes"),
    )
    return lotes, compartidos


def _ronda(lotes: DataFrame, compartidos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round over all offers of ``lotes``: the decisions (``lote_id, motivo, nuevos``), and the lots and shared documents
    left. Settles at least the first lot of each offer."""
    necesita = F.col("fijo") + F.col("comunes")
    potencia = F.when(F.col("rest") > 0, F.pow(F.lit(2), F.length(F.bin("rest")) - 1)).otherwise(1).cast("long")
    lotes = lotes.withColumn("chico", necesita < potencia)
    # First small lot of each shared document: it brings the document, later lots find it admitted.
    chicos = lotes.where("chico").select("lote_id")
    primero = compartidos.join(chicos, "lote_id", "left_semi").groupBy("oferta", "doc").agg(F.min("lote_id").alias("primero"))
    por_lote = compartidos.join(primero, ["oferta", "doc"]).groupBy("lote_id").agg(
        F.sum((F.col("primero") < F.col("lote_id")).cast("long")).alias("hallados"),
        F.sum((F.col("primero") == F.col("lote_id")).cast("long")).alias("traidos"),
    )
    x = lotes.join(por_lote, "lote_id", "left").fillna(0, ["hallados", "traidos"])
    x = x.withColumn("toma", F.when(F.col("chico"), F.col("excl") + F.col("traidos")).otherwise(0))
    x = suma_acumulada(x, ["oferta"], ["lote_id"], "toma", "acum")
    cabe = necesita - F.col("hallados") <= F.col("rest") - (F.col("acum") - F.col("toma"))
    x = x.withColumn("cabe", cabe).checkpoint(eager=True)
    fin = x.where(F.col("cabe") != F.col("chico")).groupBy("oferta").agg(F.min("lote_id").alias("fin"))
    x = x.join(fin, "oferta", "left")
    resueltos = x.where(F.col("fin").isNull() | (F.col("lote_id") <= F.col("fin"))).select(
        "oferta", "lote_id", F.when(F.col("cabe"), F.lit("ok")).otherwise(F.lit("sin_cupos")).alias("motivo"),
        F.when(F.col("cabe"), F.col("excl") + F.col("comunes") - F.col("hallados")).otherwise(0).alias("nuevos"),
    ).checkpoint(eager=True)
    aceptados = resueltos.where("motivo = 'ok'")
    ocupados = aceptados.groupBy("oferta").agg(F.sum("nuevos").alias("ocupados"))
    admitidos = compartidos.join(aceptados.select("lote_id"), "lote_id", "left_semi").select("oferta", "doc")
    quedan = lotes.join(resueltos.select("lote_id"), "lote_id", "left_anti")
    compartidos = compartidos.join(quedan.select("lote_id"), "lote_id", "left_semi").join(admitidos, ["oferta", "doc"], "left_anti")
    compartidos = compartidos.select("oferta", "doc", "lote_id").checkpoint(eager=True)
    comunes = compartidos.groupBy("lote_id").agg(F.count(F.lit(1)).alias("comunes"))
    quedan = quedan.drop("chico", "comunes").join(comunes, "lote_id", "left").join(ocupados, "oferta", "left").select(
        "oferta", "lote_id", (F.col("rest") - F.coalesce("ocupados", F.lit(0))).alias("rest"), "fijo", "excl",
        F.coalesce("comunes", F.lit(0)).alias("comunes"),
    ).checkpoint(eager=True)
    sobran = necesita > F.col("rest")
    decididos = resueltos.select("lote_id", "motivo", "nuevos").unionByName(
        quedan.where(sobran).select("lote_id", F.lit("sin_cupos").alias("motivo"), F.lit(0).cast("long").alias("nuevos")))
    return decididos, quedan.where(~sobran), compartidos


def lote_ya_inscritos(t, filas: DataFrame) -> DataFrame:
    """Per lot, how many of its distinct documents are already enrolled on its offer (the
    application's ``COUNT(*) ... ins_perdoc IN (...)``), against the tables before the batch."""
    ya = pares_inscritos(t, filas)
    docs = filas.select("lote_id", "oferta", "doc").distinct()
    n = docs.join(ya, ["doc", "oferta"], "left_semi").groupBy("lote_id").agg(F.count(F.lit(1)).alias("ya_inscritos"))
    tam = filas.groupBy("lote_id", "oferta").agg(F.count(F.lit(1)).alias("filas"))
    return tam.join(n, "lote_id", "left").select(
        "lote_id", "oferta", "filas", F.coalesce(F.col("ya_inscritos"), F.lit(0)).alias("ya_inscritos")
    )


def _escanear(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy all-or-nothing scan of the candidate lots left of one offer, in lot order (the
    offer exists and is not blocked: other lots were decided before)."""
    pdf = pdf.sort_values("lote_id")
    rest = int(pdf["rest"].iloc[0])
    admitidos: set[str] = set()
    filas = []
    for lote_id, fijo, excl, comp in zip(pdf["lote_id"], pdf["fijo"], pdf["excl"], pdf["docs"]):
        frescos = [] if comp is None else [doc for doc in comp if doc not in admitidos]
        if int(fijo) + len(frescos) > rest:
            filas.append((int(lote_id), "sin_cupos", 0))
            continue
        nuevos = int(excl) + len(frescos)
        admitidos.update(frescos)
        rest -= nuevos
        filas.append((int(lote_id), "ok", nuevos))
    return pd.DataFrame(filas, columns=["lote_id", "motivo", "nuevos"])


def decidir_lotes(t, filas: DataFrame, tam_tramo: int = TAM_TRAMO) -> DataFrame:
    """W5 decisions: one row per lot with ``motivo`` (ok / no_existe / pausada / sin_cupos) and
    ``nuevos`` (enrolments it created). The enrolments are read twice: for the batch's pairs and for its offers' seats."""
    docs = _docs_con_e0(t, filas).checkpoint(eager=True)
    clases = clasificar_lotes(t, filas, docs).checkpoint(eager=True)
    lotes, compartidos = (x.checkpoint(eager=True) for x in _candidatos(docs, clases))
    decididos = clases.where(F.col("motivo").isNotNull()).select("lote_id", "motivo", F.lit(0).cast("long").alias("nuevos"))
    # Hot offers first, in rounds; the others wait for the scan.
    espera: list[tuple[DataFrame, DataFrame]] = []
    while True:
        calientes = lotes.groupBy("oferta").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tam_tramo).select("oferta")
        if calientes.isEmpty():
            break
        espera.append((lotes.join(calientes, "oferta", "left_anti"), compartidos.join(calientes, "oferta", "left_anti")))
        hechos, lotes, compartidos = _ronda(lotes.join(calientes, "oferta", "left_semi"), compartidos.join(calientes, "oferta", "left_semi"))
        decididos = decididos.unionByName(hechos)
    for lo, co in espera:
        lotes, compartidos = lotes.unionByName(lo.select(*lotes.columns)), compartidos.unionByName(co.select(*compartidos.columns))
    listas = compartidos.groupBy("lote_id").agg(F.collect_list("doc").alias("docs"))
    resto = lotes.join(listas, "lote_id", "left").groupBy("oferta").applyInPandas(_escanear, _ESQUEMA_SALIDA)
    return decididos.unionByName(resto).join(clases.select("lote_id", "oferta", "empresa_id", "filas"), "lote_id").select(
        "lote_id", "oferta", "empresa_id", "filas", "motivo", "nuevos")


def admision_lotes(t, filas: DataFrame, tam_tramo: int = TAM_TRAMO) -> DataFrame:
    """Per lot decision (see ``decidir_lotes``)."""
    return decidir_lotes(t, filas, tam_tramo)


def _filas_aceptadas(filas: DataFrame, decision: DataFrame) -> DataFrame:
    return filas.join(decision.where(F.col("motivo") == "ok").select("lote_id"), "lote_id", "left_semi")


def nuevas_inscripciones(t, filas: DataFrame, decision: DataFrame) -> DataFrame:
    """Enrolments created by accepted lots: per (document, offer) not enrolled before, the first
    accepted lot that lists it; codes continue after the largest existing one in (lot, row) order."""
    acept = _filas_aceptadas(filas, decision)
    acept = acept.join(pares_inscritos(t, acept), ["doc", "oferta"], "left_anti")
    primero = acept.groupBy("doc", "oferta").agg(F.min(F.struct("lote_id", "fila", "empresa_id")).alias("p")).select(
        "doc", "oferta", F.col("p.lote_id").alias("lote_id"), F.col("p.fila").alias("fila"),
        F.col("p.empresa_id").alias("empresa_id"),
    )
    num = numerar(primero, ["lote_id", "fila"], "rn")
    base = mayor_valor(t["inscripcion"], "inscodigo")
    return num.select(
        (F.col("rn") + F.lit(base)).alias("inscodigo"), F.col("doc").alias("ins_perdoc"), F.col("oferta").alias("ins_oferta"),
        F.col("empresa_id").alias("ins_empresa_id"), F.lit("pendiente").alias("ins_estado"), "lote_id", "fila",
    )


def inscripcion_tras_lotes(t, filas: DataFrame, decision: DataFrame, ahora) -> DataFrame:
    """Enrolment table after the lots (new rows dated ``ahora``, the batch time)."""
    return t["inscripcion"].unionByName(fechadas(t, nuevas_inscripciones(t, filas, decision), ahora))


def fechadas(t, nuevas: DataFrame, ahora) -> DataFrame:
    """Rows of ``nuevas_inscripciones`` as enrolment rows dated ``ahora``."""
    tipo = t["inscripcion"].schema["ins_fecha"].dataType
    return nuevas.select(
        "inscodigo", "ins_perdoc", "ins_oferta", "ins_empresa_id", "ins_estado", F.lit(ahora).cast(tipo).alias("ins_fecha")
    )


def academico_tras_lotes(t, filas: DataFrame, decision: DataFrame) -> DataFrame:
    """Academic rows of the new enrolments."""
    # Only (document, offer) pairs: no numbering.
    acept = _filas_aceptadas(filas, decision).select("doc", "oferta").distinct()
    nuevas = acept.join(pares_inscritos(t, acept), ["doc", "oferta"], "left_anti")
    return t["persona_capacitacion"].unionByName(nuevas.select(F.col("doc").alias("pcap_perdoc"), F.col("oferta").alias("pcap_oferta")))


#: Fields of an employee; the person table has them with the prefix ``per``.
_CAMPOS = ["nombre", "apellido", "fechanac", "telefono", "email", "pais", "ciudad"]


def datos_de_lotes(filas: DataFrame, decision: DataFrame) -> DataFrame:
    """What accepted lots say about each document, in (lot, row) order: its first type and the last row's other fields."""
    return _filas_aceptadas(filas, decision).groupBy("doc").agg(
        F.min(F.struct("lote_id", "fila", "tipodoc")).alias("pri"),
        F.max(F.struct("lote_id", "fila", *_CAMPOS)).alias("ult"),
    ).select(
        "doc", F.col("pri.tipodoc").alias("tipodoc"),
        *[F.col(f"ult.{c}").alias(c) for c in _CAMPOS],
    )


def _valor(c: str):
    return F.col(c).try_cast("date") if c == "fechanac" else F.col(c)


def actualizar_personas(per: DataFrame, datos: DataFrame) -> DataFrame:
    """Rows of ``per`` with every field but the type and the key overwritten by ``datos_de_lotes``; other columns stay. A left
    join whose small side is the batch."""
    j = per.join(datos, per["perdoc"] == datos["doc"], "left")
    nuevo = {f"per{c}": F.when(F.col("doc").isNotNull(), _valor(c)).otherwise(F.col(f"per{c}")) for c in _CAMPOS}
    return j.select(*[nuevo[c].alias(c) if c in nuevo else F.col(c) for c in per.columns])


def personas_nuevas_de_lotes(per: DataFrame, datos: DataFrame) -> DataFrame:
    """Documents of ``datos_de_lotes`` that ``per`` does not have, found by filtering it against the batch: the
    person table is not shuffled when the batch is small."""
    existen = per.select(F.col("perdoc").alias("doc")).join(datos.select("doc"), "doc", "left_semi")
    return datos.join(existen, "doc", "left_anti").select(
        F.col("tipodoc").alias("pertipodoc"), F.col("doc").alias("perdoc"), *[_valor(c).alias(f"per{c}") for c in _CAMPOS])


def persona_tras_lotes(t, filas: DataFrame, decision: DataFrame) -> DataFrame:
    """Upsert of every employee of accepted lots in (lot, row) order: a new document is
    inserted with its first type; later rows (and existing people) get every field but the type
    and the key overwritten by the last row."""
    datos, per = datos_de_lotes(filas, decision), t["persona"]
    return actualizar_personas(per, datos).unionByName(personas_nuevas_de_lotes(per, datos))
