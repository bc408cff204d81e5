"""Read queries as DataFrame plans.

Every function takes the table map (``name -> DataFrame``) and returns a lazy DataFrame.
Point lookups of the application (one document, one offer, one company) take a DataFrame of
keys instead, so one job answers a whole batch of lookups with a join.

Join strategy is left to Catalyst and AQE: catalogue, offers and company contacts are small
dimension tables and get broadcast when the planner's size estimate (or AQE's runtime
statistics) is under ``spark.sql.autoBroadcastJoinThreshold``; enrolments, people and payment
reports are joined with shuffled sort-merge joins, and AQE splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import escalares as E

ESTADOS_LOTE_PAGABLE = ("pendiente", "rechazado")


def inscritos_por_oferta(t) -> DataFrame:
    """A1/A2: enrolments per offer (every state takes a seat, D5). Partial aggregation map-side."""
    return t["inscripcion"].groupBy(F.col("ins_oferta").alias("capofcodigo")).agg(F.count(F.lit(1)).alias("inscritos"))


def pares_inscritos(t, pedidos: DataFrame) -> DataFrame:
    """Distinct (doc, oferta) pairs of ``pedidos`` that are already enrolled. The enrolment table
    is semi-joined against the (small) requested pairs first, so it is filtered where it is
    scanned (hash join built on the request side) instead of being deduplicated whole."""
    claves = pedidos.select("doc", "oferta")  # a semi join needs no distinct on its right side
    ins = t["inscripcion"].select(F.col("ins_perdoc").alias("doc"), F.col("ins_oferta").alias("oferta"))
    return ins.join(claves, ["doc", "oferta"], "left_semi").distinct()


def _ofertas_con_curso(t, activas: bool) -> DataFrame:
    of = t["capacitacion_oferta"]
    if activas:
        of = of.where(F.col("capofestatus") == 1)
    return of.join(t["capacitacion"], of["capofcapcodigo"] == F.col("capcodigo"), "inner")


def ofertas_activas(t) -> DataFrame:
    """J1 + A1: active offers with course name and seats left (seats minus every enrolment)."""
    base = _ofertas_con_curso(t, True)
    n = inscritos_por_oferta(t)
    return (
        base.join(n, "capofcodigo", "left")
        .select(
            "capofcodigo",
            "capnombre",
            "cupos_bloqueados",
            (F.col("capofcupos") - F.coalesce(F.col("inscritos"), F.lit(0))).alias("cupos_restantes"),
        )
    )


def ofertas_disponibles(t) -> DataFrame:
    """J2 as the application runs it: the document is ignored, so it equals the active list."""
    return ofertas_activas(t)


def ofertas_panel(t) -> DataFrame:
    """Active offers with course name and total seats (dashboard)."""
    return _ofertas_con_curso(t, True).select("capofcodigo", "capnombre", "capofcupos")


def _ofertas_todas_base(t) -> DataFrame:
    base = _ofertas_con_curso(t, False)
    n = inscritos_por_oferta(t)
    return base.join(n, "capofcodigo", "left").select(
        "capofcodigo", "capnombre", "capoffecha_inicio", "capoffecha_fin", "capofcupos", "capofestatus",
        "cupos_bloqueados", F.coalesce(F.col("inscritos"), F.lit(0)).alias("inscritos"),
    )


def ofertas_todas(t) -> DataFrame:
    """J4 + A2 + O1: every offer with course, dates, flags and enrolled count, newest id first."""
    return _ofertas_todas_base(t).orderBy(F.col("capofcodigo").desc())


def ofertas_etiquetas(t) -> DataFrame:
    """The labels the offer pages print next to each offer. Seats left
    (the public pages' figure) exist for active offers only; one enrolment count serves both."""
    restantes = F.when(F.col("capofestatus") == 1, F.col("capofcupos") - F.col("inscritos"))
    return (
        _ofertas_todas_base(t)
        .withColumn("cupos_restantes", restantes)
        .select(
            "capofcodigo",
            E.fecha_local("capoffecha_inicio").alias("inicio_texto"),
            E.fecha_local("capoffecha_fin").alias("fin_texto"),
            F.col("inscritos"),
            E.etiqueta_oferta("capofestatus").alias("etiqueta_estatus"),
            F.when(E.es_uno("cupos_bloqueados"), F.lit("CERRADO")).alias("etiqueta_bloqueo"),
            E.etiqueta_cupos("cupos_bloqueados", "cupos_restantes").alias("etiqueta_cupos"),
            E.no_negativo("cupos_restantes").alias("cupos_visibles"),
            E.oferta_deshabilitada("cupos_bloqueados", "cupos_restantes").alias("deshabilitada"),
        )
    )


def cursos_pendientes(t, documentos: DataFrame | None = None) -> DataFrame:
    """J5 + P20: pending enrolments of each person with course name; ``documentos(doc)`` limits
    the people, ``None`` answers for everyone at once."""
    ins = t["inscripcion"].where(F.col("ins_estado") == "pendiente")
    if documentos is not None:
        ins = ins.join(documentos.select(F.col("doc").alias("ins_perdoc")).distinct(), "ins_perdoc", "left_semi")
    of = t["capacitacion_oferta"].select("capofcodigo", "capofcapcodigo")
    return (
        ins.join(of, ins["ins_oferta"] == of["capofcodigo"], "inner")
        .join(t["capacitacion"], F.col("capofcapcodigo") == F.col("capcodigo"), "inner")
        .select("ins_perdoc", "inscodigo", "capnombre")
    )


def _lotes(df: DataFrame | None) -> DataFrame | None:
    if df is None:
        return None
    return df.select(F.col("empresa_id").alias("ins_empresa_id"), F.col("oferta").alias("ins_oferta")).distinct()


def lote_existente(t, lotes: DataFrame | None = None) -> DataFrame:
    """People already enrolled by a company on an offer (``p.*``), per (company, offer) lot."""
    ins = t["inscripcion"].where(F.col("ins_empresa_id").isNotNull())
    lk = _lotes(lotes)
    if lk is not None:
        ins = ins.join(lk, ["ins_empresa_id", "ins_oferta"], "left_semi")
    p = t["persona"]
    return ins.join(p, ins["ins_perdoc"] == p["perdoc"], "inner").select("ins_empresa_id", "ins_oferta", *p.columns)


def lote_existente_telefono(t, lotes: DataFrame | None = None) -> DataFrame:
    """F5 + F13: the existing-lot rows as the company grid shows them (phone split, ISO date)."""
    return lote_existente(t, lotes).select(
        "ins_empresa_id",
        "ins_oferta",
        "perdoc",
        E.codpais_de("pertelefono").alias("codpais"),
        E.numero_de("pertelefono").alias("numero"),
        E.fecha_iso("perfechanac").alias("fechanac_iso"),
    )


COLUMNAS_PARTICIPANTES = [
    "inscodigo", "ins_estado", "fecha_formateada", "perdoc", "pernombre", "perapellido", "pertelefono",
    "peremail", "perpais", "perciudad", "capnombre", "titular_nombre", "titular_apellido", "banco_origen",
    "referencia", "tlf_pago", "fecha_pago", "empresa_nombre",
]


def participantes_base(t) -> DataFrame:
    """J7 without ordering: enrolment x person x offer x course, left payment reports (one row
    per report, D12) and left company contact."""
    ins = t["inscripcion"]
    p = t["persona"]
    of = t["capacitacion_oferta"].select("capofcodigo", "capofcapcodigo")
    c = t["capacitacion"].select("capcodigo", "capnombre")
    pr = t["pago_reportado"].select(
        "pago_inscodigo", "titular_nombre", "titular_apellido", "banco_origen", "referencia",
        F.col("titular_telefono").alias("tlf_pago"), "fecha_reporte",
    )
    ce = t["contacto_empresa"].select("id_contacto", "empresa_nombre")
    return (
        ins.join(p, ins["ins_perdoc"] == p["perdoc"], "inner")
        .join(of, ins["ins_oferta"] == of["capofcodigo"], "inner")
        .join(c, F.col("capofcapcodigo") == F.col("capcodigo"), "inner")
        .join(pr, ins["inscodigo"] == pr["pago_inscodigo"], "left")
        .join(ce, ins["ins_empresa_id"] == ce["id_contacto"], "left")
        .select(
            "inscodigo", "ins_estado", "ins_fecha", E.fecha_corta("ins_fecha").alias("fecha_formateada"),
            "perdoc", "pernombre", "perapellido", "pertelefono", "peremail", "perpais", "perciudad",
            "capnombre", "titular_nombre", "titular_apellido", "banco_origen", "referencia", "tlf_pago",
            E.fecha_hora("fecha_reporte").alias("fecha_pago"), "empresa_nombre",
        )
    )


def participantes(t) -> DataFrame:
    """J7 + O2: the reconciliation grid, newest enrolment first (code breaks ties, D20)."""
    return (
        participantes_base(t)
        .orderBy(F.col("ins_fecha").desc(), F.col("inscodigo").desc())
        .select(*COLUMNAS_PARTICIPANTES)
    )


def participantes_filtrados(grid: DataFrame, estado: str = "todas", empresa: str = "", capacitacion: str = "") -> DataFrame:
    """P10: the grid's three optional filters; 'todas' / '' mean no filter and SIN_EMPRESA
    selects people without a company."""
    cond = F.lit(True)
    if estado not in ("todas",):
        cond = cond & (F.col("ins_estado") == estado)
    if empresa != "":
        cond = cond & (E.empresa_o_defecto("empresa_nombre") == empresa)
    if capacitacion != "":
        cond = cond & (F.col("capnombre") == capacitacion)
    return grid.where(cond)


def participantes_etiquetas(t) -> DataFrame:
    """state label, company or SIN_EMPRESA, full name of every grid row."""
    return participantes_base(t).select(
        "inscodigo",
        "referencia",
        E.etiqueta_estado("ins_estado").alias("etiqueta_estado"),
        E.empresa_o_defecto("empresa_nombre").alias("empresa"),
        E.nombre_completo("pernombre", "perapellido").alias("nombre_completo"),
    )


def cursos_unicos(grid: DataFrame) -> DataFrame:
    """Distinct non-empty course names of the grid (filter list)."""
    return grid.where(F.col("capnombre").isNotNull() & (F.col("capnombre") != "")).select("capnombre").distinct()


def empresas_unicas(t) -> DataFrame:
    """Distinct non-empty company names of the grid (filter list). Payment reports only repeat grid
    rows, so they are not read; enrolments are reduced to (company, offer) before the dimension joins."""
    ins = t["inscripcion"].where(F.col("ins_empresa_id").isNotNull())
    pares = ins.join(t["persona"].select("perdoc"), F.col("ins_perdoc") == F.col("perdoc"), "left_semi").select("ins_empresa_id", "ins_oferta").distinct()
    of = t["capacitacion_oferta"].join(t["capacitacion"], F.col("capofcapcodigo") == F.col("capcodigo"), "left_semi").select("capofcodigo")
    ids = pares.join(of, F.col("ins_oferta") == F.col("capofcodigo"), "left_semi").select("ins_empresa_id").distinct()
    ce = t["contacto_empresa"].where(F.col("empresa_nombre").isNotNull() & (F.col("empresa_nombre") != ""))
    return ce.join(ids, F.col("id_contacto") == F.col("ins_empresa_id"), "left_semi").select("empresa_nombre").distinct()


def _correo(ins: DataFrame, t) -> DataFrame:
    p = t["persona"].select("perdoc", "peremail", "pernombre")
    of = t["capacitacion_oferta"].select("capofcodigo", "capofcapcodigo")
    return (
        ins.join(p, ins["ins_perdoc"] == p["perdoc"], "inner")
        .join(of, ins["ins_oferta"] == of["capofcodigo"], "inner")
        .join(t["capacitacion"], F.col("capofcapcodigo") == F.col("capcodigo"), "inner")
    )


def datos_correo(t, codigos: DataFrame | None = None) -> DataFrame:
    """E-mail, first name and course of each enrolment (``codigos(inscodigo)`` or all)."""
    ins = t["inscripcion"].select("inscodigo", "ins_perdoc", "ins_oferta")
    if codigos is not None:
        ins = ins.join(codigos.select("inscodigo").distinct(), "inscodigo", "left_semi")
    return _correo(ins, t).select("inscodigo", "peremail", "pernombre", "capnombre")


def correos_lote(t, lotes: DataFrame | None = None) -> DataFrame:
    """E-mail, first name and course of every enrolment of a (company, offer) lot."""
    ins = t["inscripcion"].where(F.col("ins_empresa_id").isNotNull()).select("ins_empresa_id", "ins_oferta", "ins_perdoc")
    lk = _lotes(lotes)
    if lk is not None:
        ins = ins.join(lk, ["ins_empresa_id", "ins_oferta"], "left_semi")
    return _correo(ins, t).select("ins_empresa_id", "ins_oferta", "peremail", "pernombre", "capnombre")


def lotes_pendientes(t) -> DataFrame:
    """J10 + A3: company lots awaiting review with employee count.

    Contact, offer and course ids are primary keys, so counting per (company, offer) before the
    joins gives the same groups; the joins then see one row per lot instead of one per enrolment."""
    n = (
        t["inscripcion"].where(F.col("ins_estado") == "en_revision")
        .groupBy("ins_empresa_id", "ins_oferta").agg(F.count("inscodigo").alias("total_empleados"))
    )
    ce = t["contacto_empresa"].select("id_contacto", "empresa_nombre", "emp_email")
    of = t["capacitacion_oferta"].select("capofcodigo", "capofcapcodigo")
    return (
        n.join(ce, n["ins_empresa_id"] == ce["id_contacto"], "inner")
        .join(of, n["ins_oferta"] == of["capofcodigo"], "inner")
        .join(t["capacitacion"], F.col("capofcapcodigo") == F.col("capcodigo"), "inner")
        .select("id_contacto", "empresa_nombre", "emp_email", "capofcodigo", "capnombre", "total_empleados")
    )


def lotes_empresa_pendientes(t, empresas: DataFrame | None = None) -> DataFrame:
    """J11 + A4: distinct (offer, course) a company still has to pay (pending or rejected)."""
    ins = t["inscripcion"].where(
        F.col("ins_empresa_id").isNotNull() & F.col("ins_estado").isin(*ESTADOS_LOTE_PAGABLE)
    ).select("ins_empresa_id", "ins_oferta")
    if empresas is not None:
        ins = ins.join(empresas.select(F.col("empresa_id").alias("ins_empresa_id")).distinct(), "ins_empresa_id", "left_semi")
    # Distinct before the dimension joins: the join input shrinks to one row per lot.
    ins = ins.distinct()
    of = t["capacitacion_oferta"].select("capofcodigo", "capofcapcodigo")
    return (
        ins.join(of, ins["ins_oferta"] == of["capofcodigo"], "inner")
        .join(t["capacitacion"], F.col("capofcapcodigo") == F.col("capcodigo"), "inner")
        .select("ins_empresa_id", "capofcodigo", "capnombre")
        .distinct()
    )


def estadisticas(t) -> DataFrame:
    """A5: dashboard totals in one row (active offers, pending and reconciled enrolments)."""
    # One aggregate over the union of two narrow projections: no join of one-row results.
    def flag(c):
        return F.coalesce(c, F.lit(False)).cast("long")

    cero = F.lit(0).cast("long")
    of = t["capacitacion_oferta"].select(flag(F.col("capofestatus") == 1).alias("o"), cero.alias("p"), cero.alias("c"))
    ins = t["inscripcion"].select(
        cero.alias("o"), flag(F.col("ins_estado") == "pendiente").alias("p"), flag(F.col("ins_estado") == "conciliado").alias("c")
    )
    return of.unionByName(ins).agg(
        F.coalesce(F.sum("o"), cero).alias("totalOfertas"),
        F.coalesce(F.sum("p"), cero).alias("totalPendientes"),
        F.coalesce(F.sum("c"), cero).alias("totalConciliados"),
    )


def contactos_empresa(t) -> DataFrame:
    """O3: all company contacts, newest first."""
    return t["contacto_empresa"].orderBy(F.col("creado_en").desc(), F.col("id_contacto").desc())


def contactos_etiquetas(t) -> DataFrame:
    """F14 + F15: the contact list as the companies page prints it (``tipodoc-doc``, full name of
    the representative, registration date in local format), newest first."""
    return contactos_empresa(t).select(
        "id_contacto",
        E.codigo_documento("emp_tipodoc", "emp_doc").alias("documento"),
        "empresa_nombre",
        E.nombre_completo("emp_nombre", "emp_apellido").alias("representante"),
        "emp_email",
        E.fecha_local("creado_en").alias("fecha_registro"),
    )


def capacitaciones_base(t) -> DataFrame:
    """Course catalogue by name."""
    return t["capacitacion"].select("capcodigo", "capnombre").orderBy("capnombre", "capcodigo")


def persona_por_doc(t, consultas: DataFrame) -> DataFrame:
    """Name columns of the person with each looked-up document (``consultas(cedula)``)."""
    p = t["persona"].select("perdoc", "pernombre", "perapellido")
    q = consultas.select("cedula").distinct()
    return q.join(p, q["cedula"] == p["perdoc"], "inner").select("cedula", "pernombre", "perapellido")


def clasifica_nuevos(t, consultas: DataFrame) -> DataFrame:
    """Per request, whether the document is new and the display name of a known person.

    The name is a JavaScript template literal, so a null part prints as ``null``."""
    p = t["persona"].select("perdoc", "pernombre", "perapellido")
    q = consultas.select("solicitud_id", "cedula")
    j = q.join(p, q["cedula"] == p["perdoc"], "left")
    nuevo = F.col("perdoc").isNull()
    nombre = F.concat(
        F.coalesce(F.col("pernombre"), F.lit("null")), F.lit(" "), F.coalesce(F.col("perapellido"), F.lit("null"))
    )
    return j.select("solicitud_id", "cedula", nuevo.alias("es_nuevo"), F.when(~nuevo, nombre).alias("nombre"))


def contactos_autorizados(t, consultas: DataFrame) -> DataFrame:
    """Requests whose (document, e-mail) pair is a registered company contact, with the
    contact id (the first one when several match)."""
    ce = t["contacto_empresa"].groupBy("emp_doc", "emp_email").agg(F.min("id_contacto").alias("id_contacto"))
    q = consultas.select("solicitud_id", "cedula", "email")
    return q.join(ce, (q["cedula"] == ce["emp_doc"]) & (q["email"] == ce["emp_email"]), "inner").select(
        "solicitud_id", "cedula", "email", "id_contacto"
    )


def oferta_por_id(t, ids: DataFrame) -> DataFrame:
    """Full offer rows for the requested ids (``ids(capofcodigo)``)."""
    return t["capacitacion_oferta"].join(ids.select("capofcodigo").distinct(), "capofcodigo", "left_semi")


def info_empresa(t, ids: DataFrame) -> DataFrame:
    """P5: e-mail and name of each requested company id; nulls when the id is unknown."""
    ce = t["contacto_empresa"].select("id_contacto", "emp_email", "empresa_nombre")
    q = ids.select(F.col("empresa_id")).distinct()
    return q.join(ce, q["empresa_id"] == ce["id_contacto"], "left").select("empresa_id", "emp_email", "empresa_nombre")


def lote_codigos(t, estados: tuple[str, ...], lotes: DataFrame | None = None) -> DataFrame:
    """Enrolment codes of each (company, offer) lot in the given states."""
    ins = t["inscripcion"].where(F.col("ins_empresa_id").isNotNull() & F.col("ins_estado").isin(*estados))
    lk = _lotes(lotes)
    if lk is not None:
        ins = ins.join(lk, ["ins_empresa_id", "ins_oferta"], "left_semi")
    return ins.select("ins_empresa_id", "ins_oferta", "inscodigo")


def lote_codigos_pendientes(t, lotes: DataFrame | None = None) -> DataFrame:
    """Codes of a lot that still have to be paid (pending or rejected)."""
    return lote_codigos(t, ESTADOS_LOTE_PAGABLE, lotes)


def lote_codigos_en_revision(t, lotes: DataFrame | None = None) -> DataFrame:
    """Codes of a lot in review."""
    return lote_codigos(t, ("en_revision",), lotes)


# The words of the lists' options.
PALABRA_OFERTA, PALABRA_INSCRIPCION, PALABRA_LOTE = "Código: ", "Inscripción #", "Lote #"


def opciones_ofertas(t) -> DataFrame:
    """the options of the list of offers open to a person."""
    return ofertas_disponibles(t).select("capofcodigo", E.etiqueta_con_id("capnombre", PALABRA_OFERTA, "capofcodigo").alias("opcion"))


def opciones_cursos(t) -> DataFrame:
    """the options of a person's list of courses to pay."""
    return cursos_pendientes(t).select("ins_perdoc", "inscodigo", E.etiqueta_con_id("capnombre", PALABRA_INSCRIPCION, "inscodigo").alias("opcion"))


def opciones_lotes(t) -> DataFrame:
    """the options of a company's list of lots to pay."""
    return lotes_empresa_pendientes(t).select(
        "ins_empresa_id", "capofcodigo", E.etiqueta_con_id("capnombre", PALABRA_LOTE, "capofcodigo").alias("opcion"))
