"""Registered OTP jobs, outbox, audit and typed scans."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from ..operators import cambios as K
from ..operators import consultas as C
from ..operators import otp as O
from ..operators import salidas as X
from ..operators import validacion as V
from ..sesion import asegurar_checkpoint
from ..sources import deposito as D
from ..sources import lectores
from ..sources import preparacion as P
from ..sources.esquemas import TABLAS
from .catalogo_cambios import (
    _CONTACTOS_EXTRA, _CREAR_EXTRA, _ELIM_EXTRA, _MOTIVO_OFERTA, _RECHAZO_LOTE_EXTRA, _REGISTRO_EXTRA, HORA_CAMBIOS, _vacio,
)
from .registro import ORACULO, W, consulta, tablas
from .texto import como_texto, ts

# ---------------------------------------------------------------- one-time codes

def _tk_ctes(tokens: str, intentos: str, sufijo: str = "") -> str:
    """CTEs ``tk{s}, ia{s}, ver{s}``: verdict of each attempt of ``intentos`` against ``tokens``."""
    s = sufijo
    return f"""
tk{s} AS (SELECT email, codigo, id_otp, expira_en, usado FROM (
          SELECT *, row_number() OVER (PARTITION BY email, codigo ORDER BY id_otp DESC) AS k FROM {tokens}) z WHERE k = 1),
ia{s} AS (SELECT i.intento_id, i.email, i.codigo, i.en, t.id_otp, t.expira_en, t.usado,
                 first_value(i.en) OVER (PARTITION BY t.id_otp ORDER BY i.en, i.intento_id) AS pri_en,
                 row_number() OVER (PARTITION BY t.id_otp ORDER BY i.en, i.intento_id) AS r
          FROM {intentos} i LEFT JOIN tk{s} t ON t.email = i.email AND t.codigo = i.codigo
          WHERE NOT (i.email IS NULL OR i.email = '' OR i.codigo IS NULL OR i.codigo = '')),
ver{s} AS (SELECT intento_id, email, codigo, id_otp,
                  CASE WHEN id_otp IS NULL THEN 'incorrecto' WHEN coalesce(usado = 1, false) THEN 'usado'
                       WHEN r > 1 AND coalesce(pri_en <= expira_en, false) THEN 'usado'
                       WHEN NOT coalesce(en <= expira_en, false) THEN 'expirado' ELSE 'ok' END AS veredicto
           FROM ia{s}
           UNION ALL
           SELECT intento_id, email, codigo, CAST(NULL AS BIGINT), 'faltan_datos' FROM {intentos}
           WHERE email IS NULL OR email = '' OR codigo IS NULL OR codigo = '')"""


_EMITIDAS = f"""
em AS (SELECT solicitud_id, email, codigo, en, false AS de_empresa FROM solicitud_otp
       WHERE NOT ({_vacio('cedula')} OR {_vacio('email')})
       UNION ALL
       SELECT q.solicitud_id, q.email, q.codigo, q.en, true FROM solicitud_otp_empresa q
       JOIN (SELECT emp_doc, emp_email FROM contacto_empresa GROUP BY emp_doc, emp_email) ce
         ON q.cedula = ce.emp_doc AND q.email = ce.emp_email
       WHERE NOT ({_vacio('q.cedula')} OR {_vacio('q.email')})),
numem AS (SELECT *, row_number() OVER (ORDER BY en, solicitud_id) AS rn FROM em),
ultem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY en DESC, solicitud_id DESC) AS k
                         FROM numem) z WHERE k = 1),
tokens2 AS (SELECT id_otp, email, codigo, expira_en, usado FROM token_otp t
            WHERE NOT EXISTS (SELECT 1 FROM em WHERE em.email = t.email)
            UNION ALL
            SELECT (SELECT coalesce(max(id_otp), 0) FROM token_otp) + rn, email, codigo, en + INTERVAL 15 MINUTES, 0
            FROM ultem)"""
_EMITIDAS_VISTAS = ("token_otp", "solicitud_otp", "solicitud_otp_empresa", "contacto_empresa")


def _emitidas(t):
    return O.solicitudes_emitidas(t, t["solicitud_otp"], t["solicitud_otp_empresa"])


@consulta("otp_intentos", W("token_otp", "intento_otp", extra=_tk_ctes("token_otp", "intento_otp"))
          + "SELECT * FROM ver")
def _otp_intentos(spark, sf):
    t = tablas(spark, sf)
    return O.otp_intentos(t, t["intento_otp"])


@consulta("tokens_tras_intentos", W("token_otp", "intento_otp", extra=_tk_ctes("token_otp", "intento_otp")) + f"""
SELECT id_otp, email, codigo, {ts('expira_en')},
       CASE WHEN id_otp IN (SELECT id_otp FROM ver WHERE veredicto = 'ok') THEN 1 ELSE usado END AS usado
FROM token_otp""")
def _tokens_tras_intentos(spark, sf):
    t = tablas(spark, sf)
    return como_texto(O.tokens_tras_intentos(t, O.otp_intentos(t, t["intento_otp"])))


@consulta("tokens_vigentes", W(*_EMITIDAS_VISTAS, extra=_EMITIDAS)
          + f"SELECT id_otp, email, codigo, {ts('expira_en')}, usado FROM tokens2")
def _tokens_vigentes(spark, sf):
    t = tablas(spark, sf)
    return como_texto(O.emitir_tokens(t, _emitidas(t)))


@consulta("lotes_autorizados", W(*_EMITIDAS_VISTAS, "intento_otp_empresa", "envio_lote",
                                 extra=_EMITIDAS + "," + _tk_ctes("tokens2", "intento_otp_empresa", "2") + """,
aceptado AS (SELECT v.email, i.en FROM ver2 v JOIN intento_otp_empresa i USING (intento_id) WHERE v.veredicto = 'ok'),
envio AS (SELECT l.lote_id, l.empresa_id, l.oferta, l.en, ce.emp_email, coalesce(l.sesion_email, ce.emp_email) AS quien
          FROM envio_lote l LEFT JOIN contacto_empresa ce ON ce.id_contacto = l.empresa_id),
sesion AS (SELECT e.*, (SELECT max(a.en) FROM aceptado a WHERE a.email = e.quien AND a.en <= e.en) AS desde FROM envio e)""") + """
SELECT lote_id, empresa_id, oferta,
       CASE WHEN quien IS NULL THEN 'sin_contacto' WHEN desde IS NULL THEN 'sin_codigo' WHEN en >= desde + INTERVAL 2 HOURS THEN 'sesion_expirada'
            WHEN emp_email IS NULL THEN 'sin_contacto' WHEN quien <> emp_email THEN 'codigo_ajeno' ELSE 'ok' END AS motivo
FROM sesion""")
def _lotes_autorizados(spark, sf):
    """Every lot that the portal was sent, with the verdict on its session."""
    t = tablas(spark, sf)
    t2 = P.desde_dataframes(spark, {**t, "token_otp": O.emitir_tokens(t, _emitidas(t))})
    ver = O.otp_intentos(t2, t["intento_otp_empresa"]).join(t["intento_otp_empresa"].select("intento_id", "en"), "intento_id")
    r = O.autorizar(t, t["envio_lote"], ver)
    return r.select("lote_id", "empresa_id", "oferta", F.coalesce("motivo", F.lit("ok")).alias("motivo"))


# ---------------------------------------------------------------- outbox

@consulta("outbox_otp", W(*_EMITIDAS_VISTAS, extra=_EMITIDAS) + """
SELECT CASE WHEN de_empresa THEN 'otp_empresa' ELSE 'otp' END AS plantilla, email AS destinatario,
       CAST(solicitud_id AS VARCHAR) AS entidad_id, CAST(NULL AS VARCHAR) AS nombre, CAST(NULL AS VARCHAR) AS curso,
       codigo AS referencia, CAST(NULL AS BIGINT) AS cantidad, CAST(NULL AS VARCHAR) AS empresa
FROM em""")
def _outbox_otp(spark, sf):
    t = tablas(spark, sf)
    return X.outbox_otp(_emitidas(t))


_CORREO = """FROM inscripcion i JOIN persona p ON i.ins_perdoc = p.perdoc
JOIN capacitacion_oferta co ON i.ins_oferta = co.capofcodigo JOIN capacitacion c ON co.capofcapcodigo = c.capcodigo"""


@consulta("outbox_pagos", W("pago_solicitud", "decision_pago", "persona", "capacitacion_oferta", "capacitacion") + f"""
SELECT 'pago_reportado' AS plantilla, 'ADMIN_EMAIL' AS destinatario, CAST(inscodigo AS VARCHAR) AS entidad_id,
       concat_ws(' ', titular_nombre, titular_apellido) AS nombre, CAST(NULL AS VARCHAR) AS curso, referencia,
       CAST(NULL AS BIGINT) AS cantidad, CAST(NULL AS VARCHAR) AS empresa
FROM pago_solicitud
WHERE NOT ({_vacio('inscodigo')} OR {_vacio('titular_nombre')} OR {_vacio('referencia')} OR coalesce(tiene_comprobante <> 1, true))
UNION ALL
SELECT CASE d.decision WHEN 'aprobar' THEN 'pago_aprobado' ELSE 'pago_rechazado' END, p.peremail,
       CAST(i.inscodigo AS VARCHAR), p.pernombre, c.capnombre, NULL, NULL, NULL
{_CORREO} JOIN (SELECT DISTINCT inscodigo, decision FROM decision_pago) d ON d.inscodigo = i.inscodigo""")
def _outbox_pagos(spark, sf):
    t = tablas(spark, sf)
    dp = t["decision_pago"]
    rep = K.reportar_pagos(t, t["pago_solicitud"], HORA_CAMBIOS)["resultado"].where(F.col("motivo") == "ok")
    reportes = t["pago_solicitud"].join(rep.select("solicitud_id"), "solicitud_id", "left_semi")
    return X.outbox_pagos(t, reportes, dp.where("decision = 'aprobar'"), dp.where("decision = 'rechazar'"))


@consulta("outbox_lotes", W("pago_lote_solicitud", "decision_lote", "persona", "capacitacion_oferta", "capacitacion",
                            "contacto_empresa", extra=f"""
lv AS (SELECT s.*, CASE WHEN {_vacio('oferta')} OR {_vacio('titular_nombre')} OR {_vacio('titular_apellido')}
                         OR {_vacio('referencia')} OR coalesce(tiene_comprobante <> 1, true) THEN 'faltan_datos' END AS motivo
       FROM pago_lote_solicitud s),
npend AS (SELECT ins_empresa_id AS empresa_id, ins_oferta AS oferta, COUNT(*) AS empleados FROM inscripcion
          WHERE ins_empresa_id IS NOT NULL AND ins_estado IN ('pendiente', 'rechazado') GROUP BY 1, 2),
ldec AS (SELECT v.*, n.empleados,
                CASE WHEN v.solicitud_id = min(v.solicitud_id) OVER (PARTITION BY v.empresa_id, v.oferta)
                      AND coalesce(n.empleados, 0) > 0 THEN 'ok' ELSE 'sin_pendientes' END AS decision
         FROM lv v LEFT JOIN npend n ON n.empresa_id = v.empresa_id AND n.oferta = v.oferta WHERE v.motivo IS NULL),
apr AS (SELECT DISTINCT empresa_id, oferta FROM decision_lote WHERE decision = 'aprobar'),
rl AS (SELECT DISTINCT d.empresa_id, d.oferta FROM decision_lote d WHERE d.decision = 'rechazar'
         AND EXISTS (SELECT 1 FROM inscripcion i WHERE i.ins_empresa_id = d.empresa_id AND i.ins_oferta = d.oferta
                     AND i.ins_estado = 'en_revision'))""") + f"""
SELECT 'pago_lote_reportado' AS plantilla, 'ADMIN_EMAIL' AS destinatario, CAST(l.oferta AS VARCHAR) AS entidad_id,
       concat_ws(' ', l.titular_nombre, l.titular_apellido) AS nombre, NULL AS curso, l.referencia,
       l.empleados AS cantidad, ce.emp_email AS empresa
FROM ldec l LEFT JOIN contacto_empresa ce ON ce.id_contacto = l.empresa_id WHERE l.decision = 'ok'
UNION ALL
SELECT 'lote_empleado_aprobado', p.peremail, CAST(i.ins_oferta AS VARCHAR), p.pernombre, c.capnombre, NULL, NULL,
       CAST(i.ins_empresa_id AS VARCHAR)
{_CORREO} JOIN apr ON apr.empresa_id = i.ins_empresa_id AND apr.oferta = i.ins_oferta
UNION ALL
SELECT 'lote_empresa_aprobado', ce.emp_email, CAST(a.oferta AS VARCHAR), NULL, NULL, NULL, NULL, ce.empresa_nombre
FROM apr a JOIN contacto_empresa ce ON ce.id_contacto = a.empresa_id WHERE ce.emp_email IS NOT NULL AND ce.emp_email <> ''
UNION ALL
SELECT 'lote_empresa_rechazado', ce.emp_email, CAST(r.oferta AS VARCHAR), NULL, NULL, NULL, NULL, ce.empresa_nombre
FROM rl r JOIN contacto_empresa ce ON ce.id_contacto = r.empresa_id WHERE ce.emp_email IS NOT NULL AND ce.emp_email <> ''""")
def _outbox_lotes(spark, sf):
    t = tablas(spark, sf)
    sol = t["pago_lote_solicitud"]
    res = K.reportar_pagos_lote(t, sol, HORA_CAMBIOS)["resultado"].where(F.col("motivo") == "ok")
    pagos = res.select("solicitud_id", "empleados").join(sol, "solicitud_id")
    dl = t["decision_lote"]
    rech = K.rechazar_lotes(t, dl.where("decision = 'rechazar'"))["resultado"].where(F.col("motivo") == "ok")
    return X.outbox_lotes(t, pagos, dl.where("decision = 'aprobar'"), rech)


# ---------------------------------------------------------------- audit

_AUDIT_SQL = W(
    "solicitud_registro", "capacitacion_oferta", "inscripcion", "oferta_borrador", "toggle_oferta", "oferta_edicion",
    "eliminacion", "decision_lote", "persona", "capacitacion", "contacto_alta", "contacto_empresa",
    extra=",\n".join(x.strip() for x in [_REGISTRO_EXTRA, _CREAR_EXTRA, _RECHAZO_LOTE_EXTRA, _ELIM_EXTRA, _CONTACTOS_EXTRA]),
).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT {ts('ts')}, accion, actor, entidad, entidad_id, detalle FROM (
  SELECT CAST(s.recibido_en AS TIMESTAMP) AS ts, 'NUEVO_REGISTRO' AS accion, 'publico' AS actor, 'inscripcion' AS entidad,
         r.doc AS entidad_id, CAST(r.oferta AS VARCHAR) AS detalle
  FROM res r JOIN solicitud_registro s USING (solicitud_id) WHERE r.motivo = 'ok'
  UNION ALL
  SELECT TIMESTAMP '{HORA_CAMBIOS}', 'CREACION_OFERTA', 'admin', 'capacitacion', CAST(capofcapcodigo AS VARCHAR), NULL
  FROM ov WHERE motivo IS NULL
  UNION ALL
  SELECT CAST(g.en AS TIMESTAMP), 'ESTATUS_MODIFICADO', 'admin', 'capacitacion_oferta', CAST(g.capofcodigo AS VARCHAR), NULL
  FROM toggle_oferta g WHERE g.campo = 'estatus' AND g.capofcodigo IN (SELECT capofcodigo FROM capacitacion_oferta)
  UNION ALL
  SELECT CAST(en AS TIMESTAMP), 'OFERTA_EDITADA', 'admin', 'capacitacion_oferta', CAST(capofcodigo AS VARCHAR), NULL
  FROM oferta_edicion WHERE ({_MOTIVO_OFERTA}) IS NULL
  UNION ALL
  SELECT TIMESTAMP '{HORA_CAMBIOS}', 'PARTICIPANTE_ELIMINADO', 'admin', 'inscripcion', CAST(inscodigo AS VARCHAR), NULL
  FROM hall
  UNION ALL
  SELECT TIMESTAMP '{HORA_CAMBIOS}', 'LOTE_APROBADO', 'admin', 'contacto_empresa', CAST(a.empresa_id AS VARCHAR),
         CAST(coalesce(n.n, 0) AS VARCHAR)
  FROM (SELECT DISTINCT empresa_id, oferta FROM decision_lote WHERE decision = 'aprobar') a
  LEFT JOIN (SELECT i.ins_empresa_id, i.ins_oferta, COUNT(*) AS n
             FROM inscripcion i JOIN persona p ON i.ins_perdoc = p.perdoc
             JOIN capacitacion_oferta co ON i.ins_oferta = co.capofcodigo JOIN capacitacion c ON co.capofcapcodigo = c.capcodigo
             GROUP BY 1, 2) n ON n.ins_empresa_id = a.empresa_id AND n.ins_oferta = a.oferta
  UNION ALL
  SELECT TIMESTAMP '{HORA_CAMBIOS}', 'PAGO_B2B_RECHAZADO', 'admin', 'contacto_empresa', CAST(ins_empresa_id AS VARCHAR),
         NULL FROM (SELECT DISTINCT ins_empresa_id, ins_oferta FROM rev) r
  UNION ALL
  SELECT CAST(en AS TIMESTAMP), 'NUEVA_EMPRESA', 'admin', 'contacto_empresa', empresa_nombre, NULL FROM nuevos) u"""


@consulta("auditoria", _AUDIT_SQL)
def _auditoria(spark, sf):
    """One row per business action of the batches (registrations, offer creation, edits and
    toggles, deletions, lot approvals and rejections, new company contacts)."""
    from ..operators import admision as A

    t = tablas(spark, sf)
    hora = F.lit(HORA_CAMBIOS).cast("timestamp")
    sol = t["solicitud_registro"]
    reg = A.admision_registro(t, sol).where(F.col("motivo") == "ok").join(sol.select("solicitud_id", "recibido_en"), "solicitud_id")
    partes = [
        reg.select(*X.auditoria("recibido_en", "NUEVO_REGISTRO", "publico", "inscripcion", "doc", F.col("oferta"))),
        K.crear_ofertas(t, t["oferta_borrador"])["resultado"].where(F.col("motivo") == "ok")
        .select(*X.auditoria(hora, "CREACION_OFERTA", "admin", "capacitacion", "capofcapcodigo")),
        C.oferta_por_id(t, t["toggle_oferta"].where("campo = 'estatus'")).select("capofcodigo")
        .join(t["toggle_oferta"].where("campo = 'estatus'"), "capofcodigo")
        .select(*X.auditoria("en", "ESTATUS_MODIFICADO", "admin", "capacitacion_oferta", "capofcodigo")),
        t["oferta_edicion"].transform(lambda e: e.join(
            V.ofertas_validas(e).where(F.col("motivo").isNull()).select("solicitud_id"), "solicitud_id", "left_semi"))
        .select(*X.auditoria("en", "OFERTA_EDITADA", "admin", "capacitacion_oferta", "capofcodigo")),
        K.eliminar_inscripciones(t, t["eliminacion"])["resultado"].where(F.col("motivo") == "ok")
        .select(*X.auditoria(hora, "PARTICIPANTE_ELIMINADO", "admin", "inscripcion", "inscodigo")),
        t["decision_lote"].where("decision = 'aprobar'").select("empresa_id", "oferta").distinct()
        .join(C.correos_lote(t, t["decision_lote"].where("decision = 'aprobar'"))
              .groupBy(F.col("ins_empresa_id").alias("empresa_id"), F.col("ins_oferta").alias("oferta"))
              .agg(F.count(F.lit(1)).alias("n")), ["empresa_id", "oferta"], "left")
        .select(*X.auditoria(hora, "LOTE_APROBADO", "admin", "contacto_empresa", "empresa_id",
                             F.coalesce(F.col("n"), F.lit(0)))),
        K.rechazar_lotes(t, t["decision_lote"].where("decision = 'rechazar'"))["resultado"]
        .where(F.col("motivo") == "ok")
        .select(*X.auditoria(hora, "PAGO_B2B_RECHAZADO", "admin", "contacto_empresa", "empresa_id")),
    ]
    alta = K.alta_contactos(t, t["contacto_alta"])
    partes.append(alta["resultado"].where(F.col("motivo") == "ok").join(t["contacto_alta"], "solicitud_id")
                  .select(*X.auditoria("en", "NUEVA_EMPRESA", "admin", "contacto_empresa", "empresa_nombre")))
    out = partes[0]
    for p in partes[1:]:
        out = out.unionByName(p)
    return como_texto(out)


# ---------------------------------------------------------------- typed scans

def _carpeta(spark, sf: str) -> str:
    return f"{asegurar_checkpoint(spark)}/tablas-{hashlib.sha1(sf.encode()).hexdigest()[:12]}"


def _scan(nombre: str):
    def fn(spark, sf):
        return como_texto(lectores.conformar(tablas(spark, sf)[nombre], TABLAS[nombre]))

    fn.__doc__ = f"S1: {nombre} conformed to its declared schema, as ``leer_tabla`` does with any source."
    return fn


def _scan_sql(nombre: str) -> str:
    cols = []
    for f in TABLAS[nombre].fields:
        tipo = f.dataType.simpleString()
        if tipo == "date":
            cols.append(f"strftime({f.name}, '%Y-%m-%d') AS {f.name}")
        elif tipo == "timestamp":
            cols.append(ts(f.name))
        else:
            cols.append(f.name)
    return W(nombre) + f"SELECT {', '.join(cols)} FROM {nombre}"


for _n in TABLAS:
    consulta(f"scan_{_n}", _scan_sql(_n))(_scan(_n))


@consulta("scan_solicitudes", W("solicitud_registro") + """
SELECT solicitud_id, tipodoc, doc, nombre, apellido, codpais, telefono, email, pais, ciudad, fechanac, capacitacion,
       """ + ts("recibido_en") + " FROM solicitud_registro")
def _scan_solicitudes(spark, sf):
    """Registration requests written as JSON lines and read back with the request schema."""
    destino = f"{_carpeta(spark, sf)}/solicitudes_json-{uuid.uuid4().hex}"
    lectores.escribir_json(tablas(spark, sf)["solicitud_registro"], destino)
    return como_texto(lectores.leer_solicitudes(spark, destino))


# ---------------------------------------------------------------- streaming (S2, W1 through foreachBatch)

def _deposito(spark, sf, t) -> str:
    """The stand-in tables at rest in a folder of their own."""
    raiz = f"{_carpeta(spark, sf)}/deposito-{uuid.uuid4().hex}"
    D.crear(spark, raiz, {n: t[n] for n in TABLAS})
    return raiz


def _flujo(spark, sf) -> str:
    """The registration requests as a stream of JSON lines with text ids, with broken lines among them; all files present at
    start form one ``availableNow`` batch. The folder of the tables at rest after it."""
    from ..streaming import registro_continuo as R

    t = tablas(spark, sf)
    raiz = _deposito(spark, sf, t)
    sol = t["solicitud_registro"].withColumns({c: F.col(c).cast("string") for c in ("solicitud_id", "capacitacion")})
    formato = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    lineas = sol.select(F.to_json(F.struct(*sol.columns), formato).alias("value")).unionByName(t["linea_rota"].select(F.col("linea").alias("value")))
    lineas.write.text(f"{raiz}/_entrada")
    R.iniciar(spark, f"{raiz}/_entrada", raiz, f"{raiz}/_ckpt").awaitTermination()
    return raiz


@consulta("registro_continuo", ORACULO["admision_registro"])
def _registro_continuo(spark, sf):
    """W1 as a stream: the per-request results of all epochs, equal to the one-batch ``admision_registro`` (same oracle)."""
    return D.leer_registro(spark, _flujo(spark, sf), "resultados/registro").select("solicitud_id", "doc", "oferta", "motivo", "inscodigo")


@consulta("registro_continuo_cuarentena", W("linea_rota") + "SELECT linea, 'no_es_registro' AS motivo FROM linea_rota")
def _registro_continuo_cuarentena(spark, sf):
    """The lines of the stream that are no record."""
    return D.leer_registro(spark, _flujo(spark, sf), "lineas_malas").select("linea", "motivo")


# ---------------------------------------------------------------- tables at rest

@consulta("snapshot_tras_registro", ORACULO["inscripcion_tras_registro"])
def _snapshot_tras_registro(spark, sf):
    """The enrolments read back after a batch of registrations was appended, and replayed."""
    from . import trabajos as J

    t = tablas(spark, sf)
    raiz = _deposito(spark, sf, t)
    for _ in range(2):
        J.registro(spark, raiz, t["solicitud_registro"], lote="registro-1")
    return como_texto(D.leer(spark, raiz, "inscripcion"))


@consulta("snapshot_tras_pago_lote", ORACULO["pagos_tras_lote"])
def _snapshot_tras_pago_lote(spark, sf):
    """The payment reports read back after a batch of lot payments, one row per employee, was appended. Every company
    has a live session."""
    from . import trabajos as J

    t = tablas(spark, sf)
    raiz = _deposito(spark, sf, t)
    hora = F.lit(HORA_CAMBIOS).cast("timestamp")
    sesiones = t["contacto_empresa"].select(F.col("emp_email").alias("email"), hora.alias("en"), F.lit("ok").alias("veredicto"))
    J.pagos_lote(spark, raiz, t["pago_lote_solicitud"].withColumn("en", hora), HORA_CAMBIOS, sesiones, lote="pagos-1")
    return como_texto(D.leer(spark, raiz, "pago_reportado"))


@consulta("snapshot_tras_decisiones", ORACULO["inscripcion_tras_decisiones"])
def _snapshot_tras_decisiones(spark, sf):
    """The enrolments read back after a batch of decisions rewrote the partitions it touches."""
    from . import trabajos as J

    t = tablas(spark, sf)
    raiz = _deposito(spark, sf, t)
    J.decisiones(spark, raiz, t["decision_mixta"], lote="decisiones-1")
    return como_texto(D.leer(spark, raiz, "inscripcion"))


@consulta("auditoria_ofertas", W("toggle_oferta", "oferta_edicion", "capacitacion_oferta") + f"""
SELECT {ts('ts')}, accion, actor, entidad, entidad_id, detalle FROM (
  SELECT CAST(en AS TIMESTAMP) AS ts, CASE WHEN campo = 'estatus' THEN 'ESTATUS_MODIFICADO' ELSE 'BLOQUEO_MODIFICADO' END AS accion, 'admin' AS actor,
         'capacitacion_oferta' AS entidad, CAST(capofcodigo AS VARCHAR) AS entidad_id, CAST(NULL AS VARCHAR) AS detalle
  FROM toggle_oferta WHERE capofcodigo IN (SELECT capofcodigo FROM capacitacion_oferta)
  UNION ALL
  SELECT CAST(en AS TIMESTAMP), 'OFERTA_EDITADA', 'admin', 'capacitacion_oferta', CAST(capofcodigo AS VARCHAR), NULL
  FROM oferta_edicion WHERE ({_MOTIVO_OFERTA}) IS NULL AND capofcodigo IN (SELECT capofcodigo FROM capacitacion_oferta)) u""")
def _auditoria_ofertas(spark, sf):
    """The audit rows of a batch of edits and toggles, read back from the log by its batch."""
    from . import trabajos as J

    t = tablas(spark, sf)
    raiz = _deposito(spark, sf, t)
    J.ofertas(spark, raiz, None, t["oferta_edicion"], t["toggle_oferta"], HORA_CAMBIOS, lote="ofertas-1")
    return como_texto(D.leer_registro(spark, raiz, "auditoria").where("lote = 'ofertas-1'").drop("lote"))
