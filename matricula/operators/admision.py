"""Seat admission of registration batches as one set-based job.

Sequential semantics being reproduced (one request at a time, in arrival order): offer
exists -> not blocked -> seats left = seats - enrolled >= 1 -> the (document, offer) pair is new
(else "duplicate"). Every enrolment takes a seat whatever its state (D5), null seats count as 0
and null block flags as "not blocked" (D13).

Set form (exact): only the first request of a pair that is not already enrolled can take a
seat (``nuevo``), and seats are never freed inside a batch, so with ``acum`` = running count of
``nuevo`` per offer in arrival order, the request finds ``rest - least(greatest(rest, 0),
acum - nuevo)`` seats left. Requests for missing, blocked or already full offers get their
reason whatever the running count is, which is computed by ``secuencia.suma_acumulada``
(range blocks, no single-task window per offer). Every request goes through it, resolved ones counting
nothing, so the joins with the tables run once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import consultas as C
from . import validacion as V
from .secuencia import mayor_valor, numerar, suma_acumulada

ORDEN = ["en", "solicitud_id"]


def estado_ofertas(t, pedidas: DataFrame | None = None) -> DataFrame:
    """Per offer: seats left before the batch and the block flag (one row per offer). With
    ``pedidas(oferta)`` only those offers are counted: offers and enrolments are filtered against
    the batch's offers before the count."""
    of = t["capacitacion_oferta"].select("capofcodigo", "capofcupos", "cupos_bloqueados")
    ins = t["inscripcion"]
    if pedidas is not None:
        claves = pedidas.select(F.col("oferta").alias("capofcodigo"))
        of = of.join(claves, "capofcodigo", "left_semi")
        ins = ins.join(claves.withColumnRenamed("capofcodigo", "ins_oferta"), "ins_oferta", "left_semi")
    n = C.inscritos_por_oferta({"inscripcion": ins})
    return of.join(n, "capofcodigo", "left").select(
        F.col("capofcodigo").alias("oferta"),
        (F.coalesce(F.col("capofcupos"), F.lit(0)) - F.coalesce(F.col("inscritos"), F.lit(0))).alias("rest"),
        F.coalesce(F.col("cupos_bloqueados") == 1, F.lit(False)).alias("bloqueada"),
    )


def admitir(t, pedidos: DataFrame) -> DataFrame:
    """Admission of ``pedidos(solicitud_id, doc, oferta, en)``; returns one row per request with
    ``motivo`` in (no_existe, pausada, sin_cupos, duplicado, ok)."""
    p = pedidos.select("solicitud_id", "doc", "oferta", "en")
    est = estado_ofertas(t, p)
    ya = C.pares_inscritos(t, p).withColumn("ya", F.lit(True))
    # First request of each (document, offer) pair: an aggregate (map-side partial), not a window.
    primero = p.groupBy("doc", "oferta").agg(F.min(F.struct("en", "solicitud_id")).alias("pri"))
    x = (
        p.join(est, "oferta", "left")
        .join(ya, ["doc", "oferta"], "left")
        .join(primero, ["doc", "oferta"], "left")
        .select(
            "solicitud_id", "doc", "oferta", "en",
            F.col("rest"),
            F.col("rest").isNotNull().alias("existe"),
            F.coalesce(F.col("bloqueada"), F.lit(False)).alias("bloqueada"),
            (F.col("ya").isNull() & (F.col("pri.en").eqNullSafe(F.col("en")))
             & (F.col("pri.solicitud_id") == F.col("solicitud_id"))).cast("long").alias("nuevo"),
        )
    )
    directo = (
        F.when(~F.col("existe"), F.lit("no_existe"))
        .when(F.col("bloqueada"), F.lit("pausada"))
        .when(F.col("rest") < 1, F.lit("sin_cupos"))
    )
    x = x.withColumn("motivo", directo).withColumn("nuevo", F.when(F.col("motivo").isNull(), F.col("nuevo")).otherwise(0))
    x = suma_acumulada(x, ["oferta"], ORDEN, "nuevo", "acum")
    en_carrera = (
        F.when(
            F.col("rest") - F.least(F.greatest(F.col("rest"), F.lit(0)), F.col("acum") - F.col("nuevo")) < 1,
            F.lit("sin_cupos"),
        ).when(F.col("nuevo") == 0, F.lit("duplicado")).otherwise(F.lit("ok"))
    )
    return x.select("solicitud_id", "doc", "oferta", "en", F.coalesce("motivo", en_carrera).alias("motivo"))


def con_codigos(t, admitidos: DataFrame) -> DataFrame:
    """New ``inscodigo`` for rows with motivo ok: max existing code + arrival rank."""
    ok = numerar(admitidos.where(F.col("motivo") == "ok"), ORDEN, "rn")
    base = mayor_valor(t["inscripcion"], "inscodigo")
    return ok.select("solicitud_id", (F.col("rn") + F.lit(base)).alias("inscodigo"))


def admision_registro(t, solicitudes: DataFrame) -> DataFrame:
    """Validate, then admit a batch of registration requests. One row per request:
    ``solicitud_id, doc, oferta, motivo, inscodigo`` (code only for admitted rows). A request without a
    readable arrival time has no place in the order: it is refused (``sin_fecha``) and takes no seat."""
    val = V.validar_solicitudes(solicitudes)
    val = val.withColumn("motivo", F.coalesce("motivo", F.when(F.col("recibido_en").isNull(), F.lit("sin_fecha"))))
    malos = val.where(F.col("motivo").isNotNull()).select(
        "solicitud_id", "doc", F.col("capacitacion").alias("oferta"), "motivo"
    )
    buenos = val.where(F.col("motivo").isNull()).select(
        "solicitud_id", "doc", F.col("capacitacion").alias("oferta"), F.col("recibido_en").alias("en")
    )
    adm = admitir(t, buenos).checkpoint(eager=True)
    cod = con_codigos(t, adm)
    res = adm.join(cod, "solicitud_id", "left").select("solicitud_id", "doc", "oferta", "motivo", "inscodigo")
    return res.unionByName(malos.withColumn("inscodigo", F.lit(None).cast("long")))


def inscripciones_nuevas(t, resultado: DataFrame, solicitudes: DataFrame) -> DataFrame:
    """The new enrolments (state pendiente, dated at arrival)."""
    return resultado.where(F.col("motivo") == "ok").join(
        solicitudes.select("solicitud_id", "recibido_en"), "solicitud_id", "inner"
    ).select(
        "inscodigo", F.col("doc").alias("ins_perdoc"), F.col("oferta").alias("ins_oferta"),
        F.lit(None).cast("long").alias("ins_empresa_id"), F.lit("pendiente").alias("ins_estado"),
        F.col("recibido_en").cast(t["inscripcion"].schema["ins_fecha"].dataType).alias("ins_fecha"),
    )


def inscripcion_tras_registro(t, resultado: DataFrame, solicitudes: DataFrame) -> DataFrame:
    """Enrolment table after the batch."""
    return t["inscripcion"].unionByName(inscripciones_nuevas(t, resultado, solicitudes))


def personas_nuevas(t, resultado: DataFrame, solicitudes: DataFrame) -> DataFrame:
    """People to insert if absent (the first arrival wins). A request writes its person once
    it passed the seat check, i.e. also when the enrolment turns out to be a duplicate."""
    norm = V.solicitudes_normalizadas(solicitudes)
    llegan = resultado.where(F.col("motivo").isin("ok", "duplicado")).select("solicitud_id").join(norm, "solicitud_id")
    primero = llegan.groupBy("doc").agg(F.min(F.struct("recibido_en", "solicitud_id")).alias("pri"))
    elegidas = llegan.join(primero, "doc").where(
        (F.col("pri.recibido_en") == F.col("recibido_en")) & (F.col("pri.solicitud_id") == F.col("solicitud_id"))
    )
    per = t["persona"]
    # Documents of the batch that already exist, found by filtering the person table against the
    # batch (not by an anti join that would shuffle the whole table).
    existen = per.select(F.col("perdoc").alias("doc")).join(elegidas.select("doc"), "doc", "left_semi")
    return elegidas.join(existen, "doc", "left_anti").select(
        F.col("tipodoc").alias("pertipodoc"), F.col("doc").alias("perdoc"), F.col("nombre").alias("pernombre"),
        F.col("apellido").alias("perapellido"), F.col("fechanac").try_cast("date").alias("perfechanac"),
        F.col("telefono").alias("pertelefono"), F.col("email").alias("peremail"), F.col("pais").alias("perpais"),
        F.col("ciudad").alias("perciudad"),
    )


def persona_tras_registro(t, resultado: DataFrame, solicitudes: DataFrame) -> DataFrame:
    """Person table after the batch."""
    return t["persona"].unionByName(personas_nuevas(t, resultado, solicitudes))


def academico_nuevo(resultado: DataFrame) -> DataFrame:
    """Academic record rows for admitted requests."""
    return resultado.where(F.col("motivo") == "ok").select(
        F.col("doc").alias("pcap_perdoc"), F.col("oferta").alias("pcap_oferta")
    )


def academico_tras_registro(t, resultado: DataFrame) -> DataFrame:
    """Academic table after the batch."""
    return t["persona_capacitacion"].unionByName(academico_nuevo(resultado))


def admision_rapida(t, pedidos: DataFrame) -> DataFrame:
    """Quick enrolment of known people (``cedula, capacitacion``): the same admission, no
    person write; both fields are required."""
    falta = V.falta_alguno("cedula", "capacitacion")
    malos = pedidos.where(falta).select(
        "solicitud_id", F.col("cedula").alias("doc"), F.col("capacitacion").alias("oferta"),
        F.lit("faltan_datos").alias("motivo"),
    )
    buenos = pedidos.where(~falta).select(
        "solicitud_id", F.col("cedula").alias("doc"), F.col("capacitacion").alias("oferta"), "en"
    )
    adm = admitir(t, buenos).select("solicitud_id", "doc", "oferta", "motivo")
    return adm.unionByName(malos)
