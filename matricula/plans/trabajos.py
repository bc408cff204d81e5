"""Batch jobs over tables at rest (``sources.deposito``): read the tables, apply one change set, write the
new and changed rows with the batch's results, outbox and audit rows.

Every job takes the name of its batch (``lote``; a new one if not given) and returns it. It first writes its decisions to
the log ``resultados/<job>`` and then applies them, so a batch that failed half way is completed by running it again under its
name, and a batch that is run twice changes nothing twice. Only the partitions that hold a touched row are rewritten.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admision as A
from ..operators import cambios as K
from ..operators import consultas as C
from ..operators import lotes as L
from ..operators import otp as O
from ..operators import salidas as X
from ..operators import validacion as V
from ..sources import deposito as D


def _ahora(ahora) -> str:
    return ahora or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def _nombre(trabajo: str, lote: str | None) -> str:
    return lote or f"{trabajo}-{uuid.uuid4().hex}"


def _cambiar(spark: SparkSession, raiz: str, tabla: str, claves: DataFrame, cambio, por: list[str] | None = None, sin_lote: str | None = None) -> None:
    """Rewrite the partitions of ``tabla`` that hold a row of ``claves`` with ``cambio`` applied to their rows."""
    D.reescribir(raiz, tabla, cambio(D.afectadas(spark, raiz, tabla, claves, por, sin_lote)))


def registro(spark: SparkSession, raiz: str, solicitudes: DataFrame, lote: str | None = None) -> str:
    """Admit registration requests; audit one row per enrolment created."""
    lote = _nombre("registro", lote)
    t = D.abrir(spark, raiz, sin_lote=lote)
    res = D.decidir(spark, raiz, lote, "resultados/registro", lambda: A.admision_registro(t, solicitudes))
    audit = res.where(F.col("motivo") == "ok").join(solicitudes.select("solicitud_id", "recibido_en"), "solicitud_id") \
        .select(*X.auditoria("recibido_en", "NUEVO_REGISTRO", "publico", "inscripcion", "doc", F.col("oferta")))
    D.anotar(raiz, lote, "auditoria", audit)
    D.agregar(spark, raiz, lote, "persona", A.personas_nuevas(t, res, solicitudes))
    D.agregar(spark, raiz, lote, "persona_capacitacion", A.academico_nuevo(res))
    D.agregar(spark, raiz, lote, "inscripcion", A.inscripciones_nuevas(t, res, solicitudes))
    return lote


def _sesiones(spark: SparkSession, raiz: str, veredictos: DataFrame | None) -> DataFrame:
    """Accepted and refused codes with their times: those given, or the results of the job ``intentos``."""
    if veredictos is not None:
        return veredictos
    try:
        return D.leer_registro(spark, raiz, "resultados/intentos").select("email", "en", "veredicto")
    except D.AnalysisException as e:  # no attempt was checked yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "email string, en timestamp, veredicto string")


def _con_envio(df: DataFrame) -> DataFrame:
    """Sender and time of arrival, null where the change set does not carry them."""
    for c, tipo in (("sesion_email", "string"), ("en", "timestamp")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(tipo))
    return df


def lotes(spark: SparkSession, raiz: str, filas: DataFrame, ahora=None, veredictos: DataFrame | None = None, lote: str | None = None) -> str:
    """Admit company lots (flat rows, see ``lectores.lote_explode``, with ``sesion_email`` and ``en``). Lots whose company has no
    live session (P19, ``otp.autorizar``; ``veredictos`` or the checked attempts) are reported with that reason and change nothing."""
    lote = _nombre("lotes", lote)
    t = D.abrir(spark, raiz, sin_lote=lote)

    def decidir() -> DataFrame:
        envios = _con_envio(filas).groupBy("lote_id", "oferta", "empresa_id").agg(
            F.count(F.lit(1)).alias("filas"), F.min("sesion_email").alias("sesion_email"), F.min("en").alias("en"))
        permiso = O.autorizar(t, envios, _sesiones(spark, raiz, veredictos)).checkpoint(eager=True)
        rechazados = permiso.where(F.col("motivo").isNotNull()).select(
            "lote_id", "oferta", "empresa_id", "filas", "motivo", F.lit(0).cast("long").alias("nuevos"))
        permitidas = filas.join(permiso.where(F.col("motivo").isNull()).select("lote_id"), "lote_id", "left_semi")
        return L.admision_lotes(t, permitidas).select(*rechazados.columns).unionByName(rechazados)

    dec = D.decidir(spark, raiz, lote, "resultados/lotes", decidir)
    datos = L.datos_de_lotes(filas, dec).checkpoint(eager=True)
    nuevas = L.nuevas_inscripciones(t, filas, dec).checkpoint(eager=True)
    D.agregar(spark, raiz, lote, "persona", L.personas_nuevas_de_lotes(t["persona"], datos))
    _cambiar(spark, raiz, "persona", datos.select(F.col("doc").alias("perdoc")), lambda p: L.actualizar_personas(p, datos), sin_lote=lote)
    D.agregar(spark, raiz, lote, "persona_capacitacion",
              nuevas.select(F.col("ins_perdoc").alias("pcap_perdoc"), F.col("ins_oferta").alias("pcap_oferta")))
    D.agregar(spark, raiz, lote, "inscripcion", L.fechadas(t, nuevas, _ahora(ahora)))
    return lote


def _poner_estado(spark: SparkSession, raiz: str, codigos: DataFrame, estados) -> None:
    """Set the state of enrolments (``codigos(inscodigo, ...)``) by ``estados``, a function of their rows."""
    _cambiar(spark, raiz, "inscripcion", codigos, estados)


def _quitar_pagos(spark: SparkSession, raiz: str, codigos: DataFrame) -> None:
    """Delete the payment reports of ``codigos(inscodigo)``."""
    claves = codigos.select(F.col("inscodigo").alias("pago_inscodigo"))
    _cambiar(spark, raiz, "pago_reportado", claves, lambda p: D.borrar(p, claves, ["pago_inscodigo"]))


def pagos(spark: SparkSession, raiz: str, solicitudes: DataFrame, ahora=None, lote: str | None = None) -> str:
    """Single payment reports; the administrator is notified of each accepted report."""
    lote = _nombre("pagos", lote)
    t = D.abrir(spark, raiz, sin_lote=lote)
    r = K.reportar_pagos(t, solicitudes, _ahora(ahora))
    res = D.decidir(spark, raiz, lote, "resultados/pagos", lambda: r["resultado"])
    ok = res.where(F.col("motivo") == "ok")
    aceptadas = solicitudes.join(ok.select("solicitud_id"), "solicitud_id", "left_semi")
    D.anotar(raiz, lote, "outbox", X.outbox_pagos(t, aceptadas, None, None))
    D.agregar(spark, raiz, lote, "pago_reportado", r["pagos_nuevos"])
    _poner_estado(spark, raiz, ok, lambda i: K.con_estado(i, ok, "en_revision"))
    return lote


def decisiones(spark: SparkSession, raiz: str, decision: DataFrame, lote: str | None = None) -> str:
    """``decision(inscodigo, decision in ('aprobar', 'rechazar')[, en, solicitud_id])``; approvals reconcile,
    rejections drop the reports and go back to pendiente, in arrival order; each person is notified. Without
    time or id, an enrolment's rejections count as earlier than its approvals."""
    lote = _nombre("decisiones", lote)
    t = D.abrir(spark, raiz)
    decision = _con_orden(decision)
    D.anotar(raiz, lote, "outbox", X.outbox_pagos(
        t, None, decision.where(F.col("decision") == "aprobar"), decision.where(F.col("decision") == "rechazar")))
    ultima = D.decidir(spark, raiz, lote, "resultados/decisiones", lambda: K.decision_final(decision))
    _quitar_pagos(spark, raiz, ultima.where("hubo_rechazo = 1"))
    _poner_estado(spark, raiz, ultima, lambda i: K.con_decision(i, ultima))
    return lote


def _con_orden(decision: DataFrame) -> DataFrame:
    """Arrival order (``en``, ``solicitud_id``) of decisions that carry none: rejections before approvals."""
    if "en" not in decision.columns:
        decision = decision.withColumn("en", F.lit(None).cast("timestamp"))
    if "solicitud_id" not in decision.columns:
        decision = decision.withColumn("solicitud_id", F.lit(None).cast("long"))
    sin_id = F.when(F.col("decision") == "aprobar", 1).otherwise(0).cast("long")
    return decision.withColumn("solicitud_id", F.coalesce("solicitud_id", sin_id))


def eliminaciones(spark: SparkSession, raiz: str, codigos: DataFrame, ahora=None, lote: str | None = None) -> str:
    """Delete enrolments with their reports and academic rows; audit each deletion."""
    lote = _nombre("eliminaciones", lote)
    t = D.abrir(spark, raiz)

    def decidir() -> DataFrame:
        # The person and offer of each enrolment found, so that its other rows are known once it is gone.
        res = K.eliminar_inscripciones(t, codigos)["resultado"]
        return res.join(t["inscripcion"].select("inscodigo", "ins_perdoc", "ins_oferta"), "inscodigo", "left")

    res = D.decidir(spark, raiz, lote, "resultados/eliminaciones", decidir)
    ok = res.where(F.col("motivo") == "ok")
    D.anotar(raiz, lote, "auditoria", ok.select(
        *X.auditoria(F.lit(_ahora(ahora)), "PARTICIPANTE_ELIMINADO", "admin", "inscripcion", "inscodigo")))
    _quitar_pagos(spark, raiz, ok)
    pares = ok.select(F.col("ins_perdoc").alias("pcap_perdoc"), F.col("ins_oferta").alias("pcap_oferta"))
    _cambiar(spark, raiz, "persona_capacitacion", pares, lambda p: D.borrar(p, pares, ["pcap_perdoc", "pcap_oferta"]))
    _poner_estado(spark, raiz, ok, lambda i: D.borrar(i, ok, ["inscodigo"]))
    return lote


def pagos_lote(spark: SparkSession, raiz: str, solicitudes: DataFrame, ahora=None, veredictos: DataFrame | None = None,
               lote: str | None = None) -> str:
    """Company lot payment reports; the administrator is notified of each accepted one. Reports of a
    company without a live session are refused with that reason, as in ``lotes``."""
    lote = _nombre("pagos_lote", lote)
    t = D.abrir(spark, raiz, sin_lote=lote)

    def decidir() -> DataFrame:
        permiso = O.autorizar(t, _con_envio(solicitudes), _sesiones(spark, raiz, veredictos)).checkpoint(eager=True)
        permitidas = permiso.where(F.col("motivo").isNull()).select(*solicitudes.columns)
        rechazadas = permiso.where(F.col("motivo").isNotNull()).select(
            "solicitud_id", "empresa_id", "oferta", "motivo", F.lit(0).cast("long").alias("empleados"))
        return K.reportar_pagos_lote(t, permitidas, _ahora(ahora))["resultado"].unionByName(rechazadas)

    res = D.decidir(spark, raiz, lote, "resultados/pagos_lote", decidir)
    aceptadas = res.where(F.col("motivo") == "ok").select("solicitud_id", "empleados").join(solicitudes, "solicitud_id")
    D.anotar(raiz, lote, "outbox", X.outbox_lotes(t, aceptadas, None, None))
    tomados = D.decidir(spark, raiz, lote, "pagos_lote/tomados", lambda: K.reportar_pagos_lote(
        t, aceptadas.drop("empleados"), _ahora(ahora))["pagos_nuevos"])
    D.agregar(spark, raiz, lote, "pago_reportado", tomados)
    codigos = tomados.select(F.col("pago_inscodigo").alias("inscodigo"))
    _poner_estado(spark, raiz, codigos, lambda i: K.con_estado(i, codigos, "en_revision"))
    return lote


def decisiones_lote(spark: SparkSession, raiz: str, decision: DataFrame, ahora=None, lote: str | None = None) -> str:
    """``decision(empresa_id, oferta, decision in ('aprobar', 'rechazar'))``. Approval
    reconciles every enrolment of the lot (employees and company are notified); rejection sends
    the lot's enrolments in review back to rechazado (the company is notified). In arrival order, see
    ``decisiones``."""
    lote = _nombre("decisiones_lote", lote)
    t = D.abrir(spark, raiz)
    decision = _con_orden(decision)
    ap = decision.where(F.col("decision") == "aprobar")
    res = D.decidir(spark, raiz, lote, "resultados/decisiones_lote", lambda: K.decidir_lotes_pagos(t, decision)["resultado"])
    # New state of every enrolment that changes, and whether its reports go.
    estados = D.decidir(spark, raiz, lote, "decisiones_lote/estados", lambda: K.estados_de_lotes(t, decision))
    rechazados = res.where(F.col("motivo") == "ok")
    hora = F.lit(_ahora(ahora))
    # Approval rows carry the number of employees notified, as the application logs it.
    n = C.correos_lote(t, ap).groupBy(F.col("ins_empresa_id").alias("empresa_id"), F.col("ins_oferta").alias("oferta")) \
        .agg(F.count(F.lit(1)).alias("n"))
    audit = ap.select("empresa_id", "oferta").distinct().join(n, ["empresa_id", "oferta"], "left").select(
        *X.auditoria(hora, "LOTE_APROBADO", "admin", "contacto_empresa", "empresa_id", F.coalesce(F.col("n"), F.lit(0)))
    ).unionByName(rechazados.select(
        *X.auditoria(hora, "PAGO_B2B_RECHAZADO", "admin", "contacto_empresa", "empresa_id")
    ))
    D.anotar(raiz, lote, "outbox", X.outbox_lotes(t, None, ap, rechazados))
    D.anotar(raiz, lote, "auditoria", audit)
    _quitar_pagos(spark, raiz, estados.where("sin_pagos"))
    _poner_estado(spark, raiz, estados, lambda i: K.con_estados(i, estados))
    return lote


def ofertas(spark: SparkSession, raiz: str, borradores: DataFrame | None = None, ediciones: DataFrame | None = None,
            toggles: DataFrame | None = None, ahora=None, lote: str | None = None) -> str:
    """Create offers from drafts, apply edits, then toggles (``campo`` 'estatus' or
    'bloqueo'). Every request gets a result row (edits and toggles of
    unknown offers: ``no_existe``) and every applied one an audit row."""
    lote = _nombre("ofertas", lote)
    t = D.abrir(spark, raiz, sin_lote=lote)
    of = t["capacitacion_oferta"]
    hora = F.lit(_ahora(ahora))
    resultados, auditoria = [], []

    def anotar(pedidos: DataFrame, motivo, accion: str, cuando) -> None:
        hay = of.select("capofcodigo", F.lit(True).alias("__hay"))
        r = pedidos.withColumn("motivo", motivo).join(hay, "capofcodigo", "left").withColumn(
            "motivo", F.coalesce("motivo", F.when(F.col("__hay"), "ok").otherwise("no_existe"))).checkpoint(eager=True)
        resultados.append(r.select(F.col("capofcodigo").cast("long").alias("capofcodigo"), F.lit(accion).alias("accion"), "motivo"))
        auditoria.append(r.where("motivo = 'ok'").select(*X.auditoria(cuando, accion, "admin", "capacitacion_oferta", "capofcodigo")))

    tocadas = []
    if borradores is not None:
        r = K.crear_ofertas(t, borradores)
        res = r["resultado"].checkpoint(eager=True)
        of = r["capacitacion_oferta"].checkpoint(eager=True)
        resultados.append(res.withColumn("accion", F.lit("CREACION_OFERTA")))
        auditoria.append(res.where(F.col("motivo") == "ok").select(
            *X.auditoria(hora, "CREACION_OFERTA", "admin", "capacitacion", "capofcapcodigo")))
        tocadas.append(of.join(t["capacitacion_oferta"], "capofcodigo", "left_anti").select("capofcodigo"))
    if ediciones is not None:
        val = V.ofertas_validas(ediciones)
        anotar(val, F.col("motivo"), "OFERTA_EDITADA", "en" if "en" in val.columns else hora)
        tocadas.append(val.where(F.col("motivo").isNull()).select("capofcodigo"))
        of = K.editar_ofertas({"capacitacion_oferta": of}, ediciones)
    if toggles is not None:
        for campo, nombre in (("estatus", "ESTATUS_MODIFICADO"), ("bloqueo", "BLOQUEO_MODIFICADO")):
            anotar(toggles.where(F.col("campo") == campo), F.lit(None).cast("string"), nombre, "en" if "en" in toggles.columns else hora)
        tocadas.append(toggles.select("capofcodigo"))
        for campo in ("estatus", "bloqueo"):
            of = K.alternar_ofertas({"capacitacion_oferta": of}, toggles, campo)
    # The final row of each offer that the batch makes or changes; a toggle is not repeated by a replay.
    filas = D.decidir(spark, raiz, lote, "ofertas/filas", lambda: of.join(_unir(tocadas).distinct(), "capofcodigo", "left_semi").select(*of.columns))
    D.decidir(spark, raiz, lote, "resultados/ofertas", lambda: _unir(resultados))
    D.decidir(spark, raiz, lote, "auditoria", lambda: _unir(auditoria))
    viejas = t["capacitacion_oferta"].select("capofcodigo")
    D.agregar(spark, raiz, lote, "capacitacion_oferta", filas.join(viejas, "capofcodigo", "left_anti"))
    cambiadas = filas.join(viejas, "capofcodigo", "left_semi").checkpoint(eager=True)
    _cambiar(spark, raiz, "capacitacion_oferta", cambiadas, lambda o: K.reemplazar(o, cambiadas, "capofcodigo"), sin_lote=lote)
    return lote


def _unir(partes: list[DataFrame]) -> DataFrame:
    out = partes[0]
    for p in partes[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def perfiles(spark: SparkSession, raiz: str, ediciones: DataFrame, lote: str | None = None) -> str:
    """Administrator edits of name, surname and phone."""
    lote = _nombre("perfiles", lote)
    ultima = K.ediciones_validas(ediciones)
    D.decidir(spark, raiz, lote, "resultados/perfiles", lambda: K.editar_personas(D.abrir(spark, raiz), ediciones)["resultado"])
    _cambiar(spark, raiz, "persona", ultima.select(F.col("doc").alias("perdoc")), lambda p: K.con_ediciones(p, ultima))
    return lote


def contactos(spark: SparkSession, raiz: str, altas: DataFrame, lote: str | None = None) -> str:
    """New company contacts (document and e-mail unique, first wins)."""
    lote = _nombre("contactos", lote)
    t = D.abrir(spark, raiz, sin_lote=lote)
    res = D.decidir(spark, raiz, lote, "resultados/contactos", lambda: K.alta_contactos(t, altas)["resultado"])
    ok = res.where(F.col("motivo") == "ok").select("solicitud_id", "id_contacto").join(altas, "solicitud_id")
    D.anotar(raiz, lote, "auditoria", ok.select(*X.auditoria("en", "NUEVA_EMPRESA", "admin", "contacto_empresa", "empresa_nombre")))
    D.agregar(spark, raiz, lote, "contacto_empresa", ok.withColumnRenamed("en", "creado_en"))
    return lote


def codigos(spark: SparkSession, raiz: str, personas: DataFrame, empresas: DataFrame, lote: str | None = None) -> str:
    """Issue one-time codes (people, and company contacts whose document and e-mail match)."""
    lote = _nombre("codigos", lote)
    t = D.abrir(spark, raiz, sin_lote=lote)
    emitidas = O.solicitudes_emitidas(t, personas, empresas).checkpoint(eager=True)
    D.anotar(raiz, lote, "outbox", X.outbox_otp(emitidas))
    nuevos = D.decidir(spark, raiz, lote, "codigos/tokens", lambda: O.tokens_nuevos(t, emitidas))
    D.agregar(spark, raiz, lote, "token_otp", nuevos)
    correos = emitidas.select("email")
    _cambiar(spark, raiz, "token_otp", correos, lambda k: D.borrar(k, correos, ["email"]), por=["email"], sin_lote=lote)
    return lote


def intentos(spark: SparkSession, raiz: str, intentos_: DataFrame, lote: str | None = None) -> str:
    """Check code attempts and mark the accepted tokens used. The results carry the attempt's time: they are the sessions
    of ``lotes`` and ``pagos_lote``."""
    lote = _nombre("intentos", lote)
    t = D.abrir(spark, raiz)
    ver = D.decidir(spark, raiz, lote, "resultados/intentos", lambda: O.otp_intentos(t, intentos_).join(
        intentos_.select("intento_id", F.col("en").cast("timestamp").alias("en")), "intento_id"))
    usados = ver.where(F.col("veredicto") == "ok").select("id_otp").distinct()
    _cambiar(spark, raiz, "token_otp", usados, lambda k: O.con_usados(k, usados))
    return lote
