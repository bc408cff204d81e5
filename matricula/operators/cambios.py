"""Table changes as snapshot-in / snapshot-out batch jobs.

Each function takes the current tables and a DataFrame of requests (many calls of the
application at once) and returns new table snapshots; update = left join + ``when``, delete =
``left_anti``, insert = ``unionByName``. When several requests in a batch touch the same row
the result is the one the application would reach handling them one at a time in arrival order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import escalares as E
from . import validacion as V
from .consultas import ESTADOS_LOTE_PAGABLE
from .secuencia import mayor_valor, numerar


def _marcar(df: DataFrame, claves: DataFrame, cols: list[str], bandera: str) -> DataFrame:
    """Left-join a distinct key set and expose membership as a boolean column."""
    k = claves.select(*cols).distinct().withColumn(bandera, F.lit(True))
    return df.join(k, cols, "left").withColumn(bandera, F.coalesce(F.col(bandera), F.lit(False)))


def con_estado(ins: DataFrame, codigos: DataFrame, estado: str) -> DataFrame:
    """Set ``ins_estado`` of the enrolments whose code is in ``codigos(inscodigo)``."""
    m = _marcar(ins, codigos, ["inscodigo"], "__m")
    return m.withColumn("ins_estado", F.when(F.col("__m"), F.lit(estado)).otherwise(F.col("ins_estado"))) \
        .drop("__m").select(*ins.columns)


def _sin_pagos_de(pagos: DataFrame, codigos: DataFrame) -> DataFrame:
    return pagos.join(codigos.select(F.col("inscodigo").alias("pago_inscodigo")).distinct(), "pago_inscodigo", "left_anti") \
        .select(*pagos.columns)


# ------------------------------------------------------------------ W9 single payment report

def reportar_pagos(t, solicitudes: DataFrame, ahora) -> dict[str, DataFrame]:
    """Valid reports (P16) append a payment row and put the enrolment in review, whatever
    its state and owner (D24). Returns ``resultado``, ``pago_reportado``, ``inscripcion``."""
    val = V.pagos_validos(solicitudes, lote=False)
    ok = val.where(F.col("motivo").isNull())
    tipo = t["pago_reportado"].schema["fecha_reporte"].dataType
    nuevos = ok.select(
        F.col("inscodigo").alias("pago_inscodigo"), F.lit(None).cast("long").alias("pago_empresa_id"),
        "titular_nombre", "titular_apellido", "titular_telefono", "banco_origen", "referencia",
        F.lit(ahora).cast(tipo).alias("fecha_reporte"),
    )
    return {
        "resultado": val.select("solicitud_id", "inscodigo", F.coalesce("motivo", F.lit("ok")).alias("motivo")),
        "pago_reportado": t["pago_reportado"].unionByName(nuevos),
        "pagos_nuevos": nuevos,
        "inscripcion": con_estado(t["inscripcion"], ok, "en_revision"),
    }


# ------------------------------------------------------------------ W10 lot payment report

def reportar_pagos_lote(t, solicitudes: DataFrame, ahora) -> dict[str, DataFrame]:
    """Per (company, offer) lot, the first valid report takes every enrolment in pendiente or
    rechazado (one payment row per employee) and puts them in review; a report that finds none
    is refused (``sin_pendientes``), which is what later reports of the same lot find."""
    val = V.pagos_validos(solicitudes, lote=True)
    validas = val.where(F.col("motivo").isNull())
    primera = validas.groupBy("empresa_id", "oferta").agg(F.min("solicitud_id").alias("primera"))
    pend = t["inscripcion"].where(
        F.col("ins_empresa_id").isNotNull() & F.col("ins_estado").isin(*ESTADOS_LOTE_PAGABLE)
    ).select(F.col("ins_empresa_id").alias("empresa_id"), F.col("ins_oferta").alias("oferta"), "inscodigo")
    # Only lots with a report in the batch matter: filter enrolments against them before counting.
    pend = pend.join(validas.select("empresa_id", "oferta"), ["empresa_id", "oferta"], "left_semi")
    n_pend = pend.groupBy("empresa_id", "oferta").agg(F.count(F.lit(1)).alias("empleados"))
    dec = (
        validas.join(primera, ["empresa_id", "oferta"], "left")
        .join(n_pend, ["empresa_id", "oferta"], "left")
        .withColumn(
            "motivo",
            F.when((F.col("solicitud_id") == F.col("primera")) & (F.coalesce("empleados", F.lit(0)) > 0), F.lit("ok"))
            .otherwise(F.lit("sin_pendientes")),
        )
    )
    aceptadas = dec.where(F.col("motivo") == "ok")
    codigos = aceptadas.select("empresa_id", "oferta", "titular_nombre", "titular_apellido", "titular_telefono",
                               "banco_origen", "referencia").join(pend, ["empresa_id", "oferta"], "inner")
    tipo = t["pago_reportado"].schema["fecha_reporte"].dataType
    nuevos = codigos.select(
        F.col("inscodigo").alias("pago_inscodigo"), F.col("empresa_id").alias("pago_empresa_id"),
        "titular_nombre", "titular_apellido", "titular_telefono", "banco_origen", "referencia",
        F.lit(ahora).cast(tipo).alias("fecha_reporte"),
    )
    resultado = dec.select(
        "solicitud_id", "empresa_id", "oferta", "motivo",
        F.when(F.col("motivo") == "ok", F.col("empleados")).otherwise(F.lit(0)).cast("long").alias("empleados"),
    ).unionByName(
        val.where(F.col("motivo").isNotNull()).select(
            "solicitud_id", "empresa_id", "oferta", "motivo", F.lit(0).cast("long").alias("empleados")
        )
    )
    return {
        "resultado": resultado,
        "pago_reportado": t["pago_reportado"].unionByName(nuevos),
        "pagos_nuevos": nuevos,
        "inscripcion": con_estado(t["inscripcion"], codigos, "en_revision"),
    }


# ------------------------------------------------------------------ W11, W12 administrator decisions

def aprobar_pagos(t, codigos: DataFrame) -> DataFrame:
    """Approved enrolments become conciliado (any state)."""
    return con_estado(t["inscripcion"], codigos, "conciliado")


def rechazar_pagos(t, codigos: DataFrame) -> dict[str, DataFrame]:
    """A rejected payment deletes every report of the enrolment, which goes back to
    pendiente (D2: single rejection is not rechazado)."""
    return {
        "pago_reportado": _sin_pagos_de(t["pago_reportado"], codigos),
        "inscripcion": con_estado(t["inscripcion"], codigos, "pendiente"),
    }


def decision_final(decisiones: DataFrame) -> DataFrame:
    """W11 and W12 mixed: ``decisiones(inscodigo, decision, en, solicitud_id)`` folded per enrolment in arrival order: the last decision
    (``ultima``) sets the state, any rejection (``hubo_rechazo``) deletes the reports."""
    return decisiones.groupBy("inscodigo").agg(
        F.max_by("decision", F.struct("en", "solicitud_id")).alias("ultima"),
        F.max((F.col("decision") == "rechazar").cast("int")).alias("hubo_rechazo"),
    )


def con_decision(ins: DataFrame, ultima: DataFrame) -> DataFrame:
    """Enrolments with the state that ``decision_final`` gives them."""
    nuevo = F.when(F.col("ultima") == "rechazar", "pendiente").when(F.col("ultima") == "aprobar", "conciliado")
    return ins.join(ultima.select("inscodigo", "ultima"), "inscodigo", "left") \
        .withColumn("ins_estado", F.coalesce(nuevo, "ins_estado")).select(*ins.columns)


def decidir_pagos(t, decisiones: DataFrame) -> dict[str, DataFrame]:
    """W11 and W12 mixed, in arrival order (see ``decision_final``)."""
    ultima = decision_final(decisiones)
    return {
        "pago_reportado": _sin_pagos_de(t["pago_reportado"], ultima.where("hubo_rechazo = 1")),
        "inscripcion": con_decision(t["inscripcion"], ultima),
    }


# ------------------------------------------------------------------ W13, W14 lot decisions

def _lote_cols(lotes: DataFrame) -> DataFrame:
    return lotes.select(F.col("empresa_id").alias("ins_empresa_id"), F.col("oferta").alias("ins_oferta")).distinct()


def aprobar_lotes(t, lotes: DataFrame) -> DataFrame:
    """Every enrolment of the (company, offer) lot becomes conciliado, whatever its
    state (D3)."""
    ins = t["inscripcion"]
    m = _marcar(ins, _lote_cols(lotes), ["ins_empresa_id", "ins_oferta"], "__m")
    return m.withColumn("ins_estado", F.when(F.col("__m"), F.lit("conciliado")).otherwise(F.col("ins_estado"))) \
        .select(*ins.columns)


def rechazar_lotes(t, lotes: DataFrame) -> dict[str, DataFrame]:
    """Only enrolments in review: their reports are deleted and they become rechazado; a lot
    with none in review is refused (``sin_en_revision``) and changes nothing."""
    ins = t["inscripcion"]
    en_rev = ins.where(F.col("ins_estado") == "en_revision").join(
        _lote_cols(lotes), ["ins_empresa_id", "ins_oferta"], "left_semi"
    )
    n = en_rev.groupBy("ins_empresa_id", "ins_oferta").agg(F.count(F.lit(1)).alias("empleados"))
    lk = lotes.select("empresa_id", "oferta").distinct()
    resultado = lk.join(n, (lk["empresa_id"] == n["ins_empresa_id"]) & (lk["oferta"] == n["ins_oferta"]), "left").select(
        "empresa_id", "oferta",
        F.when(F.col("empleados").isNull(), F.lit("sin_en_revision")).otherwise(F.lit("ok")).alias("motivo"),
        F.coalesce(F.col("empleados"), F.lit(0)).alias("empleados"),
    )
    return {
        "resultado": resultado,
        "pago_reportado": _sin_pagos_de(t["pago_reportado"], en_rev),
        "inscripcion": con_estado(ins, en_rev, "rechazado"),
    }


def estados_de_lotes(t, decisiones: DataFrame) -> DataFrame:
    """W13 and W14 mixed: ``decisiones(empresa_id, oferta, decision, en, solicitud_id)`` folded per lot in arrival order, as the
    enrolments that change: ``inscodigo``, new ``estado`` and whether their reports go (``sin_pagos``). The first decision of a lot settles
    its enrolments in review: rejected first, they become rechazado and lose their reports. A later approval
    reconciles the whole lot (D3); a later rejection finds none in review."""
    orden = F.struct("en", "solicitud_id")
    por_lote = decisiones.groupBy(F.col("empresa_id").alias("ins_empresa_id"), F.col("oferta").alias("ins_oferta")).agg(
        F.min_by("decision", orden).alias("primera"), F.max((F.col("decision") == "aprobar").cast("int")).alias("aprobado"))
    rechazada = (F.col("primera") == "rechazar") & (F.col("ins_estado") == "en_revision")
    estado = F.when(F.col("aprobado") == 1, "conciliado").when(rechazada, "rechazado")
    return t["inscripcion"].join(por_lote, ["ins_empresa_id", "ins_oferta"]).select(
        "inscodigo", estado.alias("estado"), F.coalesce(rechazada, F.lit(False)).alias("sin_pagos")).where("estado IS NOT NULL")


def con_estados(ins: DataFrame, estados: DataFrame) -> DataFrame:
    """Enrolments with the new states of ``estados(inscodigo, estado)``."""
    return ins.join(estados.select("inscodigo", "estado"), "inscodigo", "left") \
        .withColumn("ins_estado", F.coalesce("estado", "ins_estado")).select(*ins.columns)


def decidir_lotes_pagos(t, decisiones: DataFrame) -> dict[str, DataFrame]:
    """W13 and W14 mixed, in arrival order (see ``estados_de_lotes``). ``resultado``: one row per lot with a rejection."""
    estados = estados_de_lotes(t, decisiones)
    por_lote = decisiones.groupBy("empresa_id", "oferta").agg(
        F.min_by("decision", F.struct("en", "solicitud_id")).alias("primera"), F.max((F.col("decision") == "rechazar").cast("int")).alias("rechazos"))
    r = rechazar_lotes(t, por_lote.where("primera = 'rechazar'"))["resultado"]
    tarde = por_lote.where("primera <> 'rechazar' AND rechazos = 1").select(
        "empresa_id", "oferta", F.lit("sin_en_revision").alias("motivo"), F.lit(0).cast("long").alias("empleados"))
    return {
        "resultado": r.unionByName(tarde), "pago_reportado": _sin_pagos_de(t["pago_reportado"], estados.where("sin_pagos")),
        "inscripcion": con_estados(t["inscripcion"], estados),
    }


# ------------------------------------------------------------------ W15 delete with cascade

def eliminar_inscripciones(t, codigos: DataFrame) -> dict[str, DataFrame]:
    """Delete enrolments with their payment reports and academic rows (those of the same
    person and offer); an unknown code is reported (``no_encontrada``) and changes nothing."""
    ins = t["inscripcion"]
    pedidos = codigos.select("inscodigo").distinct()
    hallados = ins.join(pedidos, "inscodigo", "left_semi").select("inscodigo", "ins_perdoc", "ins_oferta")
    resultado = _marcar(pedidos, hallados, ["inscodigo"], "__h").select(
        "inscodigo", F.when(F.col("__h"), F.lit("ok")).otherwise(F.lit("no_encontrada")).alias("motivo")
    )
    pares = hallados.select(F.col("ins_perdoc").alias("pcap_perdoc"), F.col("ins_oferta").alias("pcap_oferta")).distinct()
    pc = t["persona_capacitacion"]
    return {
        "resultado": resultado,
        "pago_reportado": _sin_pagos_de(t["pago_reportado"], hallados),
        "persona_capacitacion": pc.join(pares, ["pcap_perdoc", "pcap_oferta"], "left_anti").select(*pc.columns),
        "inscripcion": ins.join(hallados.select("inscodigo"), "inscodigo", "left_anti").select(*ins.columns),
    }


# ------------------------------------------------------------------ W16-W19 offers

def crear_ofertas(t, borradores: DataFrame) -> dict[str, DataFrame]:
    """Valid drafts (P15) become active offers; codes continue after the largest one. The
    application leaves ``cupos_bloqueados`` to the column default, taken as 0 (not blocked)."""
    val = V.ofertas_validas(borradores)
    ok = val.where(F.col("motivo").isNull())
    # Arrival order when the drafts carry it (the application numbers them as they come).
    llegada = [c for c in ("en", "solicitud_id") if c in ok.columns]
    num = numerar(ok, [*llegada, "capofcapcodigo", "fecha_inicio", "fecha_fin", "cupos"], "rn")
    of = t["capacitacion_oferta"]
    base = mayor_valor(of, "capofcodigo")
    nuevas = num.select(
        (F.col("rn") + F.lit(base)).alias("capofcodigo"), F.col("capofcapcodigo").cast("int").alias("capofcapcodigo"),
        F.col("fecha_inicio").cast("date").alias("capoffecha_inicio"), F.col("fecha_fin").cast("date").alias("capoffecha_fin"),
        F.col("cupos").cast("int").alias("capofcupos"), F.lit(1).alias("capofestatus"), F.lit(0).alias("cupos_bloqueados"),
    )
    return {
        "resultado": val.select(*borradores.columns, F.coalesce("motivo", F.lit("ok")).alias("motivo"), "fecha_ilegible"),
        "capacitacion_oferta": of.unionByName(nuevas),
    }


def editar_ofertas(t, ediciones: DataFrame) -> DataFrame:
    """The last valid edit of each existing offer (in arrival order) replaces course,
    dates and seats; edits of unknown ids change nothing."""
    val = V.ofertas_validas(ediciones).where(F.col("motivo").isNull())
    ultima = val.groupBy("capofcodigo").agg(
        F.max(F.struct("en", "solicitud_id", "capofcapcodigo", "fecha_inicio", "fecha_fin", "cupos")).alias("u")
    )
    of = t["capacitacion_oferta"]
    j = of.join(ultima, "capofcodigo", "left")
    hay = F.col("u").isNotNull()
    return j.select(
        "capofcodigo",
        F.when(hay, F.col("u.capofcapcodigo")).otherwise(F.col("capofcapcodigo")).cast("int").alias("capofcapcodigo"),
        F.when(hay, F.col("u.fecha_inicio")).otherwise(F.col("capoffecha_inicio")).alias("capoffecha_inicio"),
        F.when(hay, F.col("u.fecha_fin")).otherwise(F.col("capoffecha_fin")).alias("capoffecha_fin"),
        F.when(hay, F.col("u.cupos")).otherwise(F.col("capofcupos")).cast("int").alias("capofcupos"),
        "capofestatus",
        "cupos_bloqueados",
    )


def _alternar(valor, veces) -> F.Column:
    """D14 applied ``veces`` times: 1 -> 0, anything else (null too) -> 1."""
    uno = F.when(E.es_uno(valor), F.lit(0)).otherwise(F.lit(1))
    return F.when(veces.isNull() | (veces == 0), valor).when(veces % 2 == 1, uno).otherwise(1 - uno)


def alternar_ofertas(t, toggles: DataFrame, campo: str) -> DataFrame:
    """W18 (``campo='estatus'``: capofestatus) / W19 (``'bloqueo'``: cupos_bloqueados): each
    request toggles the flag once; toggles of unknown offers change nothing."""
    col = {"estatus": "capofestatus", "bloqueo": "cupos_bloqueados"}[campo]
    n = toggles.where(F.col("campo") == campo).groupBy("capofcodigo").agg(F.count(F.lit(1)).alias("__n"))
    of = t["capacitacion_oferta"]
    j = of.join(n, "capofcodigo", "left")
    return j.withColumn(col, _alternar(F.col(col), F.col("__n")).cast("int")).select(*of.columns)


# ------------------------------------------------------------------ W20 profile edit

def _revisar_ediciones(ediciones: DataFrame) -> DataFrame:
    return ediciones.withColumn("motivo", F.when(V.falta_alguno("doc", "nombre", "apellido"), F.lit("faltan_datos")))


def ediciones_validas(ediciones: DataFrame) -> DataFrame:
    """The last valid edit of each document, as ``doc`` and a struct ``u``."""
    return _revisar_ediciones(ediciones).where(F.col("motivo").isNull()).groupBy("doc").agg(
        F.max(F.struct("en", "solicitud_id", "nombre", "apellido", "telefono")).alias("u"))


def con_ediciones(per: DataFrame, ultima: DataFrame) -> DataFrame:
    """People with name, surname and phone of ``ediciones_validas``; other columns stay."""
    j = per.join(ultima, per["perdoc"] == ultima["doc"], "left")
    nuevo = {f"per{n}": F.when(F.col("u").isNotNull(), F.col(f"u.{n}")).otherwise(F.col(f"per{n}")) for n in ("nombre", "apellido", "telefono")}
    return j.select(*[nuevo[c].alias(c) if c in nuevo else F.col(c) for c in per.columns])


def editar_personas(t, ediciones: DataFrame) -> dict[str, DataFrame]:
    """Edits need document, name and surname; the last valid edit of each document sets
    name, surname and phone (no casing applied)."""
    return {"resultado": _revisar_ediciones(ediciones).select("solicitud_id", "doc", F.coalesce("motivo", F.lit("ok")).alias("motivo")),
            "persona": con_ediciones(t["persona"], ediciones_validas(ediciones))}


def reemplazar(filas: DataFrame, nuevas: DataFrame, clave: str) -> DataFrame:
    """``filas`` with the columns of ``nuevas`` where that has the key; other columns stay."""
    n = nuevas.select(F.col(clave).alias("__k"), F.struct(*[c for c in nuevas.columns if c != clave]).alias("__n"))
    j = filas.join(n, filas[clave] == F.col("__k"), "left")
    otras = {c: F.when(F.col("__k").isNotNull(), F.col(f"__n.{c}")).otherwise(F.col(c)).alias(c) for c in nuevas.columns if c != clave}
    return j.select(*[otras.get(c, F.col(c)) for c in filas.columns])


# ------------------------------------------------------------------ W21 company contacts

CAMPOS_CONTACTO = ["empresa_nombre", "emp_tipodoc", "emp_doc", "emp_nombre", "emp_apellido", "emp_email", "emp_telefono"]


def alta_contactos(t, altas: DataFrame) -> dict[str, DataFrame]:
    """New company contacts need every field; the document and the e-mail are unique, so a
    request colliding with an existing contact or with an earlier accepted request is refused.

    Exact first-wins order without a sequential scan: in each round, a pending request that is
    the earliest of its document group and of its e-mail group is accepted (no earlier request
    can still block it), and requests colliding with those are refused. Every round accepts at
    least the earliest pending request; the rounds follow the longest chain of collisions and end
    when nothing is pending. A round is one checkpoint of its rows."""
    val = altas.withColumn("motivo", F.when(V.falta_alguno(*CAMPOS_CONTACTO), F.lit("faltan_datos")))
    ce = t["contacto_empresa"]
    buenos = val.where(F.col("motivo").isNull()).drop("motivo")
    pend = buenos.join(ce.select(F.col("emp_doc")).distinct(), "emp_doc", "left_anti") \
        .join(ce.select(F.col("emp_email")).distinct(), "emp_email", "left_anti")
    orden = F.struct("en", "solicitud_id")
    aceptados = buenos.where(F.lit(False))
    while True:
        docs = pend.groupBy("emp_doc").agg(F.min(orden).alias("__pd"))
        correos = pend.groupBy("emp_email").agg(F.min(orden).alias("__pe"))
        con_orden = pend.join(docs, "emp_doc").join(correos, "emp_email").withColumn(
            "__gana", (orden == F.col("__pd")) & (orden == F.col("__pe"))).drop("__pd", "__pe")
        # Whether the document or the e-mail goes to a winner of this round.
        toma = F.max(F.col("__gana").cast("int"))
        ronda = con_orden.join(con_orden.groupBy("emp_doc").agg(toma.alias("__td")), "emp_doc") \
            .join(con_orden.groupBy("emp_email").agg(toma.alias("__te")), "emp_email") \
            .withColumn("__sigue", (F.col("__td") == 0) & (F.col("__te") == 0)).drop("__td", "__te").checkpoint(eager=True)
        aceptados = aceptados.unionByName(ronda.where("__gana").select(*buenos.columns))
        pend = ronda.where("__sigue").select(*buenos.columns)
        if pend.isEmpty():
            break
    num = numerar(aceptados, ["en", "solicitud_id"], "rn")
    base = mayor_valor(ce, "id_contacto")
    nuevos = num.select(
        (F.col("rn") + F.lit(base)).alias("id_contacto"), "solicitud_id", *CAMPOS_CONTACTO, F.col("en").alias("creado_en")
    )
    resultado = val.join(nuevos.select("solicitud_id", "id_contacto"), "solicitud_id", "left").select(
        "solicitud_id",
        F.when(F.col("motivo").isNotNull(), F.col("motivo"))
        .when(F.col("id_contacto").isNotNull(), F.lit("ok")).otherwise(F.lit("duplicado")).alias("motivo"),
        "id_contacto",
    )
    tipo = ce.schema["creado_en"].dataType
    altas_ = nuevos.drop("solicitud_id").withColumn("creado_en", F.col("creado_en").cast(tipo))
    return {"resultado": resultado, "contacto_empresa": ce.unionByName(altas_), "contactos_nuevos": altas_}
