"""Notification outbox (S8) and audit rows (S7) built from the same change sets as the jobs.

Mail delivery itself is not built: an outbox row says who gets which template with which
parameters. All templates share one flat row shape so the outbox is one appendable table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import consultas as C

# The application's message kinds and the administrator mailbox placeholder.
PLANTILLAS = (
    "otp", "otp_empresa", "pago_reportado", "pago_lote_reportado", "pago_aprobado", "pago_rechazado",
    "lote_empleado_aprobado", "lote_empresa_aprobado", "lote_empresa_rechazado",
)
ADMIN = "ADMIN_EMAIL"

COLUMNAS_OUTBOX = ["plantilla", "destinatario", "entidad_id", "nombre", "curso", "referencia", "cantidad", "empresa"]
COLUMNAS_AUDITORIA = ["ts", "accion", "actor", "entidad", "entidad_id", "detalle"]


def _fila(plantilla: str, destinatario, entidad_id=None, nombre=None, curso=None, referencia=None, cantidad=None,
          empresa=None) -> list[Column]:
    def c(x, tipo="string"):
        if x is None:
            return F.lit(None).cast(tipo)
        return (F.col(x) if isinstance(x, str) else x).cast(tipo)

    dest = F.lit(destinatario) if destinatario == ADMIN else F.col(destinatario)
    return [
        F.lit(plantilla).alias("plantilla"), dest.cast("string").alias("destinatario"),
        c(entidad_id).alias("entidad_id"), c(nombre).alias("nombre"), c(curso).alias("curso"),
        c(referencia).alias("referencia"), c(cantidad, "long").alias("cantidad"), c(empresa).alias("empresa"),
    ]


def _unir(t, partes: list[DataFrame]) -> DataFrame:
    """Union of the parts; without any, no rows of the outbox shape."""
    vacio = t["inscripcion"].limit(0).select(*[F.lit(None).cast("long" if c == "cantidad" else "string").alias(c) for c in COLUMNAS_OUTBOX])
    out = vacio
    for p in partes:
        out = p if out is vacio else out.unionByName(p)
    return out


def outbox_otp(emitidas: DataFrame) -> DataFrame:
    """Code mails: one per request that got a code (``solicitud_id, email, codigo, de_empresa``);
    company-portal requests use the company template."""
    filas = _fila("otp", "email", entidad_id="solicitud_id", referencia="codigo")
    filas[0] = F.when(F.coalesce(F.col("de_empresa"), F.lit(False)), F.lit("otp_empresa")).otherwise(F.lit("otp")) \
        .alias("plantilla")
    return emitidas.select(*filas)


def outbox_pagos(t, reportes: DataFrame | None, aprobados: DataFrame | None, rechazados: DataFrame | None) -> DataFrame:
    """Payment mails: a report notifies the administrator; an approval or rejection notifies
    the person (when the enrolment's person, offer and course exist, J8). Any input may be None."""
    partes = []
    if reportes is not None:
        partes.append(reportes.select(*_fila(
            "pago_reportado", ADMIN, entidad_id="inscodigo",
            nombre=F.concat_ws(" ", F.col("titular_nombre"), F.col("titular_apellido")), referencia="referencia",
        )))
    for plantilla, codigos in (("pago_aprobado", aprobados), ("pago_rechazado", rechazados)):
        if codigos is not None:
            partes.append(C.datos_correo(t, codigos).select(
                *_fila(plantilla, "peremail", "inscodigo", "pernombre", "capnombre")
            ))
    return _unir(t, partes)


def outbox_lotes(t, pagos_lote: DataFrame | None, aprobados: DataFrame | None, rechazados: DataFrame | None) -> DataFrame:
    """Lot mails: an accepted lot payment notifies the administrator with the employee count;
    an approved lot notifies every employee of the lot (all states, D3) and the company; a
    rejected lot (one that had enrolments in review) notifies the company. Any input may be None."""
    ce = t["contacto_empresa"].select(F.col("id_contacto").alias("empresa_id"), "emp_email", "empresa_nombre")
    partes = []
    if pagos_lote is not None:
        partes.append(pagos_lote.join(ce, "empresa_id", "left").select(*_fila(
            "pago_lote_reportado", ADMIN, entidad_id="oferta",
            nombre=F.concat_ws(" ", F.col("titular_nombre"), F.col("titular_apellido")),
            referencia="referencia", cantidad="empleados", empresa="emp_email",
        )))
    if aprobados is not None:
        partes.append(C.correos_lote(t, aprobados).select(*_fila(
            "lote_empleado_aprobado", "peremail", "ins_oferta", "pernombre", "capnombre", empresa="ins_empresa_id"
        )))
    for plantilla, lotes in (("lote_empresa_aprobado", aprobados), ("lote_empresa_rechazado", rechazados)):
        if lotes is not None:
            partes.append(
                lotes.select("empresa_id", "oferta").distinct().join(ce, "empresa_id", "inner")
                .where(F.col("emp_email").isNotNull() & (F.col("emp_email") != ""))
                .select(*_fila(plantilla, "emp_email", "oferta", empresa="empresa_nombre"))
            )
    return _unir(t, partes)


def auditoria(ts, accion: str, actor, entidad: str, entidad_id, detalle=None) -> list[Column]:
    """Columns of one audit row kind; combine kinds with ``unionByName``."""
    def c(x):
        if x is None:
            return F.lit(None).cast("string")
        return (F.col(x) if isinstance(x, str) else x).cast("string")

    return [
        (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp").alias("ts"), F.lit(accion).alias("accion"),
        (F.lit(actor) if actor in ("publico", "admin") else c(actor)).alias("actor"), F.lit(entidad).alias("entidad"),
        c(entidad_id).alias("entidad_id"), c(detalle).alias("detalle"),
    ]
