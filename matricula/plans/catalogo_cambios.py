"""Registered change jobs with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import admision as A
from ..operators import cambios as K
from ..operators import lotes as L
from ..operators import validacion as V
from ..sesion import asegurar_checkpoint
from ..sources import lectores as S
from ..sources import preparacion as P
from .registro import W, consulta, tablas
from .texto import como_texto, d, ts

# Batch time stamped on rows the database dates with its own clock (fixed for reproducibility).
HORA_CAMBIOS = "2024-02-01 00:00:00"


def _vacio(c: str) -> str:
    return f"({c} IS NULL OR CAST({c} AS VARCHAR) = '')"


_MOTIVO_REGISTRO = (
    "CASE WHEN " + " OR ".join(_vacio(c) for c in V.CAMPOS_REGISTRO) + " THEN 'faltan_datos'\n"
    r"     WHEN tipodoc = 'Ced' AND NOT coalesce(regexp_full_match(doc, '\d{6,9}'), false) THEN 'cedula_invalida'" "\n"
    r"     WHEN tipodoc <> 'Ced' AND NOT coalesce(regexp_full_match(doc, '[a-zA-Z0-9]{6,20}'), false) THEN 'documento_invalido'" "\n"
    r"     WHEN NOT coalesce(regexp_full_match(codpais, '\+\d{1,4}'), false) THEN 'codpais_invalido'" "\n"
    r"     WHEN NOT coalesce(regexp_full_match(telefono, '\d{7,15}'), false) THEN 'telefono_invalido' END"
)


def _admision_ctes(pedidos_sql: str) -> str:
    """CTEs ``pedidos, est, x, y, adm, cod`` of the admission formula over ``pedidos_sql``
    (columns solicitud_id, doc, oferta, en)."""
    return f"""
pedidos AS ({pedidos_sql}),
est AS (SELECT co.capofcodigo AS oferta, coalesce(co.capofcupos, 0) - coalesce(n.n, 0) AS rest,
               coalesce(co.cupos_bloqueados = 1, false) AS bloqueada
        FROM capacitacion_oferta co
        LEFT JOIN (SELECT ins_oferta, COUNT(*) AS n FROM inscripcion GROUP BY ins_oferta) n ON n.ins_oferta = co.capofcodigo),
x AS (SELECT p.solicitud_id, p.doc, p.oferta, p.en, e.rest, e.oferta IS NOT NULL AS existe,
             coalesce(e.bloqueada, false) AS bloqueada,
             CASE WHEN ya.doc IS NULL AND row_number() OVER (PARTITION BY p.doc, p.oferta ORDER BY p.en, p.solicitud_id) = 1
                  THEN 1 ELSE 0 END AS nuevo
      FROM pedidos p LEFT JOIN est e ON e.oferta = p.oferta
      LEFT JOIN (SELECT DISTINCT ins_perdoc AS doc, ins_oferta AS oferta FROM inscripcion) ya
        ON ya.doc = p.doc AND ya.oferta = p.oferta),
y AS (SELECT x.*, sum(nuevo) OVER (PARTITION BY oferta ORDER BY en, solicitud_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acum FROM x),
adm AS (SELECT solicitud_id, doc, oferta, en,
               CASE WHEN NOT existe THEN 'no_existe' WHEN bloqueada THEN 'pausada' WHEN rest < 1 THEN 'sin_cupos'
                    WHEN rest - least(greatest(rest, 0), acum - nuevo) < 1 THEN 'sin_cupos'
                    WHEN nuevo = 0 THEN 'duplicado' ELSE 'ok' END AS motivo
        FROM y),
cod AS (SELECT solicitud_id,
               (SELECT coalesce(max(inscodigo), 0) FROM inscripcion) + row_number() OVER (ORDER BY en, solicitud_id) AS inscodigo
        FROM adm WHERE motivo = 'ok')"""


# Validation + admission CTEs of the registration batch (``val``, ..., ``res``).
_REGISTRO_EXTRA = (
    f"val AS (SELECT s.*, {_MOTIVO_REGISTRO} AS motivo FROM solicitud_registro s),"
    + _admision_ctes("SELECT solicitud_id, doc, capacitacion AS oferta, recibido_en AS en FROM val WHERE motivo IS NULL")
    + """,
res AS (SELECT a.solicitud_id, a.doc, a.oferta, a.motivo, c.inscodigo FROM adm a LEFT JOIN cod c USING (solicitud_id)
        UNION ALL
        SELECT solicitud_id, doc, capacitacion, motivo, NULL FROM val WHERE motivo IS NOT NULL)"""
)


def _registro_ctes(*mas: str) -> str:
    return W("solicitud_registro", "capacitacion_oferta", "inscripcion", *mas, extra=_REGISTRO_EXTRA)


_REGISTRO_CTES = _registro_ctes()


def _registro(spark, sf):
    t = tablas(spark, sf)
    sol = t["solicitud_registro"]
    return t, sol, A.admision_registro(t, sol)


@consulta("entradas_de_pagina", W("entrada_pagina") + """
SELECT solicitud_id, trim(cedula) AS cedula, trim(email) AS email, ltrim(telefono, '0') AS telefono FROM entrada_pagina""")
def _entradas_de_pagina(spark, sf):
    return V.entrada_de_pagina(tablas(spark, sf)["entrada_pagina"])


@consulta("solicitudes_validas", W("solicitud_registro") + f"""
SELECT solicitud_id, doc, capacitacion FROM (SELECT s.*, {_MOTIVO_REGISTRO} AS motivo FROM solicitud_registro s) v
WHERE motivo IS NULL""")
def _solicitudes_validas(spark, sf):
    return V.solicitudes_validas(tablas(spark, sf)["solicitud_registro"]).select("solicitud_id", "doc", "capacitacion")


@consulta("solicitudes_rechazadas", W("solicitud_registro") + f"""
SELECT solicitud_id, doc, motivo FROM (SELECT s.*, {_MOTIVO_REGISTRO} AS motivo FROM solicitud_registro s) v
WHERE motivo IS NOT NULL""")
def _solicitudes_rechazadas(spark, sf):
    return V.solicitudes_rechazadas(tablas(spark, sf)["solicitud_registro"])


@consulta("solicitudes_normalizadas", W("solicitud_registro") + f"""
SELECT solicitud_id, tipodoc, doc, upper(substr(nombre, 1, 1)) || lower(substr(nombre, 2)) AS nombre,
       upper(substr(apellido, 1, 1)) || lower(substr(apellido, 2)) AS apellido, codpais || ' ' || telefono AS telefono,
       email, pais, ciudad, fechanac, capacitacion, {ts('recibido_en')}
FROM (SELECT s.*, {_MOTIVO_REGISTRO} AS motivo FROM solicitud_registro s) v WHERE motivo IS NULL""")
def _solicitudes_normalizadas(spark, sf):
    sol = tablas(spark, sf)["solicitud_registro"]
    return como_texto(V.solicitudes_normalizadas(V.solicitudes_validas(sol)))


@consulta("admision_registro", _REGISTRO_CTES + "SELECT solicitud_id, doc, oferta, motivo, inscodigo FROM res")
def _admision_registro(spark, sf):
    return _registro(spark, sf)[2]


@consulta("inscripcion_tras_registro", _REGISTRO_CTES + f"""
SELECT inscodigo, ins_perdoc, ins_oferta, ins_empresa_id, ins_estado, {ts('ins_fecha')} FROM (
  SELECT * FROM inscripcion
  UNION ALL
  SELECT r.inscodigo, r.doc, r.oferta, NULL, 'pendiente', s.recibido_en
  FROM res r JOIN solicitud_registro s USING (solicitud_id) WHERE r.motivo = 'ok') u""")
def _inscripcion_tras_registro(spark, sf):
    t, sol, res = _registro(spark, sf)
    return como_texto(A.inscripcion_tras_registro(t, res, sol))


@consulta("persona_tras_registro", _registro_ctes("persona") + f""",
llegan AS (SELECT v.*, row_number() OVER (PARTITION BY v.doc ORDER BY v.recibido_en, v.solicitud_id) AS k
           FROM val v JOIN res r USING (solicitud_id) WHERE r.motivo IN ('ok', 'duplicado'))
SELECT pertipodoc, perdoc, pernombre, perapellido, {d('perfechanac')}, pertelefono, peremail, perpais, perciudad FROM (
  SELECT * FROM persona
  UNION ALL
  SELECT tipodoc, doc, upper(substr(nombre, 1, 1)) || lower(substr(nombre, 2)),
         upper(substr(apellido, 1, 1)) || lower(substr(apellido, 2)), TRY_CAST(fechanac AS DATE),
         codpais || ' ' || telefono, email, pais, ciudad
  FROM llegan WHERE k = 1 AND doc NOT IN (SELECT perdoc FROM persona)) u""")
def _persona_tras_registro(spark, sf):
    t, sol, res = _registro(spark, sf)
    return como_texto(A.persona_tras_registro(t, res, sol))


@consulta("academico_tras_registro", _registro_ctes("persona_capacitacion") + """
SELECT pcap_perdoc, pcap_oferta FROM persona_capacitacion
UNION ALL SELECT doc, oferta FROM res WHERE motivo = 'ok'""")
def _academico_tras_registro(spark, sf):
    t, sol, res = _registro(spark, sf)
    return A.academico_tras_registro(t, res)


@consulta("admision_rapida", W(
    "solicitud_rapida", "capacitacion_oferta", "inscripcion",
    extra=_admision_ctes(
        f"SELECT solicitud_id, cedula AS doc, capacitacion AS oferta, en FROM solicitud_rapida "
        f"WHERE NOT ({_vacio('cedula')} OR {_vacio('capacitacion')})"
    ).lstrip(),
) + f"""
SELECT solicitud_id, doc, oferta, motivo FROM adm
UNION ALL
SELECT solicitud_id, cedula, capacitacion, 'faltan_datos' FROM solicitud_rapida
WHERE {_vacio('cedula')} OR {_vacio('capacitacion')}""")
def _admision_rapida(spark, sf):
    t = tablas(spark, sf)
    return A.admision_rapida(t, t["solicitud_rapida"])


# ---------------------------------------------------------------- company lots




@consulta("lote_explode", W("lote_fila") + """
SELECT lote_id, empresa_id, oferta, row_number() OVER (PARTITION BY lote_id ORDER BY fila) - 1 AS posicion,
       fila, tipodoc, doc, nombre, apellido, telefono, email, fechanac, pais, ciudad
FROM lote_fila""")
def _lote_explode(spark, sf):
    return S.lote_explode(S.anidar_lotes(tablas(spark, sf)["lote_fila"]))


# Nested lots from disk, with their quarantine: rows of whole lots, and what keeps the others back.
_LOTES_JSON = W("lote_fila_pagina", "lote_vacio", extra="""
puesta AS (SELECT * EXCLUDE (nombre, apellido), trim(nombre) AS nombre, trim(apellido) AS apellido,
                  row_number() OVER (PARTITION BY lote_id ORDER BY fila) - 1 AS posicion FROM lote_fila_pagina),
incompleta AS (SELECT lote_id, posicion FROM puesta WHERE nombre = '' OR fechanac IS NULL)""")


def _lotes_json(spark, sf):
    t = tablas(spark, sf)
    ids = ("lote_id", "empresa_id", "oferta")
    con_filas = S.anidar_lotes(t["lote_fila_pagina"]).withColumns({c: F.col(c).cast("string") for c in ids})
    nadie = F.when(F.col("empresa_id") != "x", F.array()).cast(con_filas.schema["empleados"].dataType)
    vacios = t["lote_vacio"].withColumn("empleados", nadie)
    ruta = f"{asegurar_checkpoint(spark)}/lotes-{uuid.uuid4().hex}"
    S.escribir_json(con_filas.unionByName(vacios), ruta)
    return S.revisar_lotes(S.leer_lotes(spark, ruta))


@consulta("lotes_json", _LOTES_JSON + """
SELECT lote_id, empresa_id, oferta, posicion, fila, tipodoc, doc, nombre, apellido, telefono, email, fechanac, pais, ciudad
FROM puesta WHERE lote_id NOT IN (SELECT lote_id FROM incompleta)""")
def _lotes_json_filas(spark, sf):
    """S3: nested lots written as JSON with text ids, read back and checked."""
    return _lotes_json(spark, sf)[0].drop("sesion_email", "en")


@consulta("lotes_json_cuarentena", _LOTES_JSON + """
SELECT lote_id, posicion, 'empleado_incompleto' AS motivo FROM incompleta
UNION ALL
SELECT CAST(lote_id AS BIGINT), NULL, CASE WHEN empresa_id = 'x' THEN 'id_ilegible' ELSE 'sin_empleados' END FROM lote_vacio""")
def _lotes_json_cuarentena(spark, sf):
    return _lotes_json(spark, sf)[1]


@consulta("lotes_completos", W("lote_fila") + """
SELECT lote_id, COUNT(*) AS filas,
       bool_and(coalesce(trim(doc) <> '', false) AND coalesce(trim(nombre) <> '', false) AND coalesce(trim(email) <> '', false)
                AND coalesce(trim(fechanac) <> '', false) AND coalesce(trim(telefono) <> '', false)) AS completo,
       CAST(sum(CASE WHEN coalesce(trim(doc) <> '', false) AND coalesce(trim(nombre) <> '', false)
                 AND coalesce(trim(email) <> '', false) AND coalesce(trim(fechanac) <> '', false)
                 AND coalesce(trim(telefono) <> '', false) THEN 0 ELSE 1 END) AS BIGINT) AS filas_incompletas
FROM lote_fila GROUP BY lote_id""")
def _lotes_completos(spark, sf):
    return V.lotes_completos(tablas(spark, sf)["lote_fila"])


@consulta("lote_ya_inscritos", W("lote_fila", "inscripcion") + """
SELECT l.lote_id, l.oferta, l.filas, coalesce(n.ya, 0) AS ya_inscritos
FROM (SELECT lote_id, oferta, COUNT(*) AS filas FROM lote_fila GROUP BY lote_id, oferta) l
LEFT JOIN (SELECT d.lote_id, COUNT(*) AS ya FROM (SELECT DISTINCT lote_id, oferta, doc FROM lote_fila) d
           WHERE EXISTS (SELECT 1 FROM inscripcion i WHERE i.ins_perdoc = d.doc AND i.ins_oferta = d.oferta)
           GROUP BY d.lote_id) n ON n.lote_id = l.lote_id""")
def _lote_ya_inscritos(spark, sf):
    return L.lote_ya_inscritos(tablas(spark, sf), tablas(spark, sf)["lote_fila"])


# The sequential lot semantics written directly as a recursive query (an oracle independent of
# the set-based shortcuts of ``lotes.decidir_lotes``): per offer, lots in order; state = seats
# left and the documents admitted so far in the batch.
_LOTES_CTES = W("lote_fila", "inscripcion", "capacitacion_oferta", extra=f"""
e0 AS (SELECT DISTINCT ins_perdoc AS doc, ins_oferta AS oferta FROM inscripcion),
ldocs AS (SELECT DISTINCT d.lote_id, d.oferta, d.doc, e.doc IS NOT NULL AS en_e0
          FROM lote_fila d LEFT JOIN e0 e ON e.doc = d.doc AND e.oferta = d.oferta),
lot AS (SELECT l.lote_id, l.oferta, l.empresa_id, l.filas, coalesce(y.ya0, 0) AS ya0,
               coalesce(y.nuevos_docs, CAST([] AS VARCHAR[])) AS nuevos_docs,
               row_number() OVER (PARTITION BY l.oferta ORDER BY l.lote_id) AS k
        FROM (SELECT lote_id, oferta, empresa_id, COUNT(*) AS filas FROM lote_fila GROUP BY lote_id, oferta, empresa_id) l
        LEFT JOIN (SELECT lote_id, count(*) FILTER (WHERE en_e0) AS ya0, list(doc) FILTER (WHERE NOT en_e0) AS nuevos_docs
                   FROM ldocs GROUP BY lote_id) y ON y.lote_id = l.lote_id),
estl AS (SELECT co.capofcodigo AS oferta, coalesce(co.capofcupos, 0) - coalesce(n.n, 0) AS rest,
                coalesce(co.cupos_bloqueados = 1, false) AS bloqueada
         FROM capacitacion_oferta co
         LEFT JOIN (SELECT ins_oferta, COUNT(*) AS n FROM inscripcion GROUP BY ins_oferta) n ON n.ins_oferta = co.capofcodigo),
scan(oferta, k, rest, existe, bloqueada, admitidos, lote_id, motivo, nuevos) AS (
  SELECT o.oferta, CAST(0 AS BIGINT), CAST(coalesce(e.rest, 0) AS BIGINT), e.oferta IS NOT NULL,
         coalesce(e.bloqueada, false), CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT)
  FROM (SELECT DISTINCT oferta FROM lot) o LEFT JOIN estl e ON e.oferta = o.oferta
  UNION ALL
  SELECT z.oferta, z.k, z.rest - CASE WHEN z.motivo = 'ok' THEN len(z.frescos) ELSE 0 END, z.existe, z.bloqueada,
         CASE WHEN z.motivo = 'ok' THEN list_concat(z.admitidos, z.frescos) ELSE z.admitidos END,
         z.lote_id, z.motivo, CASE WHEN z.motivo = 'ok' THEN len(z.frescos) ELSE 0 END
  FROM (SELECT w.*, CASE WHEN w.need <= 0 THEN 'ok' WHEN NOT w.existe THEN 'no_existe' WHEN w.bloqueada THEN 'pausada'
                         WHEN w.rest < w.need THEN 'sin_cupos' ELSE 'ok' END AS motivo
        FROM (SELECT s.oferta, l.k, s.rest, s.existe, s.bloqueada, s.admitidos, l.lote_id,
                     l.filas - l.ya0 - len(list_filter(l.nuevos_docs, lambda x: list_contains(s.admitidos, x))) AS need,
                     list_filter(l.nuevos_docs, lambda x: NOT list_contains(s.admitidos, x)) AS frescos
              FROM scan s JOIN lot l ON l.oferta = s.oferta AND l.k = s.k + 1) w) z),
dec AS (SELECT l.lote_id, l.oferta, l.empresa_id, l.filas, s.motivo, s.nuevos FROM scan s JOIN lot l ON l.lote_id = s.lote_id),
acc AS (SELECT lote_id FROM dec WHERE motivo = 'ok'),
filas_ok AS (SELECT f.* FROM lote_fila f JOIN acc a ON a.lote_id = f.lote_id),
primeras AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY f.doc, f.oferta ORDER BY f.lote_id, f.fila) AS r
                            FROM filas_ok f
                            WHERE NOT EXISTS (SELECT 1 FROM e0 WHERE e0.doc = f.doc AND e0.oferta = f.oferta)) z
             WHERE r = 1)""").replace("WITH ", "WITH RECURSIVE ", 1)


def _lotes(spark, sf):
    t = tablas(spark, sf)
    filas = t["lote_fila"]
    return t, filas, L.admision_lotes(t, filas)


@consulta("admision_lotes", _LOTES_CTES + "SELECT lote_id, oferta, empresa_id, filas, motivo, nuevos FROM dec")
def _admision_lotes(spark, sf):
    """Set-based pre-decisions plus the greedy per-offer scan (the oracle is the sequential
    semantics as a recursive query)."""
    return _lotes(spark, sf)[2]


@consulta("inscripcion_tras_lotes", _LOTES_CTES + f"""
SELECT inscodigo, ins_perdoc, ins_oferta, ins_empresa_id, ins_estado, {ts('ins_fecha')} FROM (
  SELECT * FROM inscripcion
  UNION ALL
  SELECT (SELECT coalesce(max(inscodigo), 0) FROM inscripcion) + row_number() OVER (ORDER BY lote_id, fila),
         doc, oferta, empresa_id, 'pendiente', TIMESTAMP '{HORA_CAMBIOS}'
  FROM primeras) u""")
def _inscripcion_tras_lotes(spark, sf):
    t, filas, dec = _lotes(spark, sf)
    return como_texto(L.inscripcion_tras_lotes(t, filas, dec, HORA_CAMBIOS))


@consulta("academico_tras_lotes", _LOTES_CTES + """,
persona_capacitacion AS (SELECT ins_perdoc AS pcap_perdoc, ins_oferta AS pcap_oferta FROM inscripcion)
SELECT pcap_perdoc, pcap_oferta FROM persona_capacitacion UNION ALL SELECT doc, oferta FROM primeras""")
def _academico_tras_lotes(spark, sf):
    t, filas, dec = _lotes(spark, sf)
    return L.academico_tras_lotes(t, filas, dec)


@consulta("persona_tras_lotes", _LOTES_CTES.replace("WITH RECURSIVE ", "WITH RECURSIVE persona AS ("
                                                    + P.sql_duckdb("persona") + "),\n", 1) + f""",
ult AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY doc ORDER BY lote_id DESC, fila DESC) AS r
                       FROM filas_ok f) z WHERE r = 1),
pri AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY doc ORDER BY lote_id, fila) AS r
                       FROM filas_ok f) z WHERE r = 1)
SELECT pertipodoc, perdoc, pernombre, perapellido, {d('perfechanac')}, pertelefono, peremail, perpais, perciudad FROM (
  SELECT p.pertipodoc, p.perdoc,
         CASE WHEN u.doc IS NULL THEN p.pernombre ELSE u.nombre END AS pernombre,
         CASE WHEN u.doc IS NULL THEN p.perapellido ELSE u.apellido END AS perapellido,
         CASE WHEN u.doc IS NULL THEN p.perfechanac ELSE TRY_CAST(u.fechanac AS DATE) END AS perfechanac,
         CASE WHEN u.doc IS NULL THEN p.pertelefono ELSE u.telefono END AS pertelefono,
         CASE WHEN u.doc IS NULL THEN p.peremail ELSE u.email END AS peremail,
         CASE WHEN u.doc IS NULL THEN p.perpais ELSE u.pais END AS perpais,
         CASE WHEN u.doc IS NULL THEN p.perciudad ELSE u.ciudad END AS perciudad
  FROM persona p LEFT JOIN ult u ON u.doc = p.perdoc
  UNION ALL
  SELECT pr.tipodoc, u.doc, u.nombre, u.apellido, TRY_CAST(u.fechanac AS DATE), u.telefono, u.email, u.pais, u.ciudad
  FROM ult u JOIN pri pr ON pr.doc = u.doc
  WHERE NOT EXISTS (SELECT 1 FROM persona p WHERE p.perdoc = u.doc)) x""")
def _persona_tras_lotes(spark, sf):
    t, filas, dec = _lotes(spark, sf)
    return como_texto(L.persona_tras_lotes(t, filas, dec))


# ---------------------------------------------------------------- payments and decisions


_HORA_SQL = f"TIMESTAMP '{HORA_CAMBIOS}'"
_PAGO_COLS = "pago_inscodigo, pago_empresa_id, titular_nombre, titular_apellido, titular_telefono, banco_origen, referencia"
_INS_COLS = "inscodigo, ins_perdoc, ins_oferta, ins_empresa_id, ins_estado"
_PAGO_SEL = f"SELECT {_PAGO_COLS}, {ts('fecha_reporte')} FROM"
_INS_SEL = f"SELECT {_INS_COLS}, {ts('ins_fecha')} FROM"
_MOTIVO_PAGO = (
    f"CASE WHEN {_vacio('inscodigo')} OR {_vacio('titular_nombre')} OR {_vacio('referencia')} "
    "OR coalesce(tiene_comprobante <> 1, true) THEN 'faltan_datos' END"
)
_PAGO_CTES = W("pago_solicitud", "pago_reportado", extra=f"pv AS (SELECT s.*, {_MOTIVO_PAGO} AS motivo FROM pago_solicitud s)")


def _pagos(spark, sf):
    t = tablas(spark, sf)
    return K.reportar_pagos(t, t["pago_solicitud"], HORA_CAMBIOS)


@consulta("pagos_validos", _PAGO_CTES + "SELECT solicitud_id, inscodigo, coalesce(motivo, 'ok') AS motivo FROM pv")
def _pagos_validos(spark, sf):
    return _pagos(spark, sf)["resultado"]


@consulta("pagos_tras_reporte", _PAGO_CTES + f"""{_PAGO_SEL} (
  SELECT * FROM pago_reportado
  UNION ALL
  SELECT inscodigo, NULL, titular_nombre, titular_apellido, titular_telefono, banco_origen, referencia, {_HORA_SQL}
  FROM pv WHERE motivo IS NULL) u""")
def _pagos_tras_reporte(spark, sf):
    return como_texto(_pagos(spark, sf)["pago_reportado"])


@consulta("inscripcion_tras_pago", _PAGO_CTES + f"""{_INS_SEL} (
  SELECT inscodigo, ins_perdoc, ins_oferta, ins_empresa_id,
         CASE WHEN inscodigo IN (SELECT inscodigo FROM pv WHERE motivo IS NULL) THEN 'en_revision' ELSE ins_estado END AS ins_estado,
         ins_fecha FROM inscripcion) u""")
def _inscripcion_tras_pago(spark, sf):
    return como_texto(_pagos(spark, sf)["inscripcion"])


_MOTIVO_PAGO_LOTE = (
    f"CASE WHEN {_vacio('oferta')} OR {_vacio('titular_nombre')} OR {_vacio('titular_apellido')} OR {_vacio('referencia')} "
    "OR coalesce(tiene_comprobante <> 1, true) THEN 'faltan_datos' END"
)
_PAGO_LOTE_CTES = W("pago_lote_solicitud", "pago_reportado", extra=f"""
lv AS (SELECT s.*, {_MOTIVO_PAGO_LOTE} AS motivo FROM pago_lote_solicitud s),
pend AS (SELECT ins_empresa_id AS empresa_id, ins_oferta AS oferta, inscodigo FROM inscripcion
         WHERE ins_empresa_id IS NOT NULL AND ins_estado IN ('pendiente', 'rechazado')),
npend AS (SELECT empresa_id, oferta, COUNT(*) AS empleados FROM pend GROUP BY empresa_id, oferta),
ldec AS (SELECT v.*, n.empleados AS n_pend,
                CASE WHEN v.solicitud_id = min(v.solicitud_id) OVER (PARTITION BY v.empresa_id, v.oferta)
                      AND coalesce(n.empleados, 0) > 0 THEN 'ok' ELSE 'sin_pendientes' END AS decision
         FROM lv v LEFT JOIN npend n ON n.empresa_id = v.empresa_id AND n.oferta = v.oferta WHERE v.motivo IS NULL),
lcod AS (SELECT d.*, p.inscodigo FROM ldec d JOIN pend p ON p.empresa_id = d.empresa_id AND p.oferta = d.oferta
         WHERE d.decision = 'ok')""")


def _pagos_lote(spark, sf):
    t = tablas(spark, sf)
    return K.reportar_pagos_lote(t, t["pago_lote_solicitud"], HORA_CAMBIOS)


@consulta("pago_lote_resultado", _PAGO_LOTE_CTES + """
SELECT solicitud_id, empresa_id, oferta, decision AS motivo, CASE WHEN decision = 'ok' THEN n_pend ELSE 0 END AS empleados FROM ldec
UNION ALL SELECT solicitud_id, empresa_id, oferta, motivo, 0 FROM lv WHERE motivo IS NOT NULL""")
def _pago_lote_resultado(spark, sf):
    return _pagos_lote(spark, sf)["resultado"]


@consulta("pagos_tras_lote", _PAGO_LOTE_CTES + f"""{_PAGO_SEL} (
  SELECT * FROM pago_reportado
  UNION ALL
  SELECT inscodigo, empresa_id, titular_nombre, titular_apellido, titular_telefono, banco_origen, referencia, {_HORA_SQL}
  FROM lcod) u""")
def _pagos_tras_lote(spark, sf):
    return como_texto(_pagos_lote(spark, sf)["pago_reportado"])


@consulta("inscripcion_tras_pago_lote", _PAGO_LOTE_CTES + f"""{_INS_SEL} (
  SELECT inscodigo, ins_perdoc, ins_oferta, ins_empresa_id,
         CASE WHEN inscodigo IN (SELECT inscodigo FROM lcod) THEN 'en_revision' ELSE ins_estado END AS ins_estado,
         ins_fecha FROM inscripcion) u""")
def _inscripcion_tras_pago_lote(spark, sf):
    return como_texto(_pagos_lote(spark, sf)["inscripcion"])


def _decision(t, d: str):
    return t["decision_pago"].where(f"decision = '{d}'")


def _estado_sql(cond: str, estado: str) -> str:
    return f"""{_INS_SEL} (
  SELECT inscodigo, ins_perdoc, ins_oferta, ins_empresa_id,
         CASE WHEN {cond} THEN '{estado}' ELSE ins_estado END AS ins_estado, ins_fecha FROM inscripcion) u"""


@consulta("inscripcion_tras_aprobar", W("inscripcion", "decision_pago")
          + _estado_sql("inscodigo IN (SELECT inscodigo FROM decision_pago WHERE decision = 'aprobar')", "conciliado"))
def _inscripcion_tras_aprobar(spark, sf):
    t = tablas(spark, sf)
    return como_texto(K.aprobar_pagos(t, _decision(t, "aprobar")))


@consulta("inscripcion_tras_rechazo", W("inscripcion", "decision_pago")
          + _estado_sql("inscodigo IN (SELECT inscodigo FROM decision_pago WHERE decision = 'rechazar')", "pendiente"))
def _inscripcion_tras_rechazo(spark, sf):
    t = tablas(spark, sf)
    return como_texto(K.rechazar_pagos(t, _decision(t, "rechazar"))["inscripcion"])


@consulta("pagos_tras_rechazo", W("pago_reportado", "decision_pago") + f"""{_PAGO_SEL} pago_reportado
WHERE pago_inscodigo NOT IN (SELECT inscodigo FROM decision_pago WHERE decision = 'rechazar')""")
def _pagos_tras_rechazo(spark, sf):
    t = tablas(spark, sf)
    return como_texto(K.rechazar_pagos(t, _decision(t, "rechazar"))["pago_reportado"])


def _lote_decision(t, d: str):
    return t["decision_lote"].where(f"decision = '{d}'")


@consulta("lote_tras_aprobar", W("inscripcion", "decision_lote") + _estado_sql(
    "EXISTS (SELECT 1 FROM decision_lote d WHERE d.decision = 'aprobar' AND d.empresa_id = inscripcion.ins_empresa_id "
    "AND d.oferta = inscripcion.ins_oferta)", "conciliado"))
def _lote_tras_aprobar(spark, sf):
    t = tablas(spark, sf)
    return como_texto(K.aprobar_lotes(t, _lote_decision(t, "aprobar")))


_RECHAZO_LOTE_EXTRA = """
rl AS (SELECT DISTINCT empresa_id, oferta FROM decision_lote WHERE decision = 'rechazar'),
rev AS (SELECT i.inscodigo, i.ins_empresa_id, i.ins_oferta FROM inscripcion i JOIN rl
          ON rl.empresa_id = i.ins_empresa_id AND rl.oferta = i.ins_oferta WHERE i.ins_estado = 'en_revision')"""
_RECHAZO_LOTE_CTES = W("inscripcion", "decision_lote", "pago_reportado", extra=_RECHAZO_LOTE_EXTRA)


@consulta("lote_tras_rechazo", _RECHAZO_LOTE_CTES + _estado_sql("inscodigo IN (SELECT inscodigo FROM rev)", "rechazado"))
def _lote_tras_rechazo(spark, sf):
    t = tablas(spark, sf)
    return como_texto(K.rechazar_lotes(t, _lote_decision(t, "rechazar"))["inscripcion"])


@consulta("pagos_tras_rechazo_lote", _RECHAZO_LOTE_CTES + f"""{_PAGO_SEL} pago_reportado
WHERE pago_inscodigo NOT IN (SELECT inscodigo FROM rev)""")
def _pagos_tras_rechazo_lote(spark, sf):
    t = tablas(spark, sf)
    return como_texto(K.rechazar_lotes(t, _lote_decision(t, "rechazar"))["pago_reportado"])


@consulta("lote_rechazo_resultado", _RECHAZO_LOTE_CTES + """
SELECT rl.empresa_id, rl.oferta, CASE WHEN n.n IS NULL THEN 'sin_en_revision' ELSE 'ok' END AS motivo, coalesce(n.n, 0) AS empleados
FROM rl LEFT JOIN (SELECT ins_empresa_id, ins_oferta, COUNT(*) AS n FROM rev GROUP BY 1, 2) n
  ON n.ins_empresa_id = rl.empresa_id AND n.ins_oferta = rl.oferta""")
def _lote_rechazo_resultado(spark, sf):
    t = tablas(spark, sf)
    return K.rechazar_lotes(t, _lote_decision(t, "rechazar"))["resultado"]


# Mixed decisions, one at a time in arrival order: a recursive query folds each enrolment's decisions over its state and
# whether its reports are still there.
_DECISIONES_CTES = W("inscripcion", "pago_reportado", "decision_mixta", extra="""
orden AS (SELECT *, row_number() OVER (PARTITION BY inscodigo ORDER BY en, solicitud_id) AS k FROM decision_mixta),
paso(inscodigo, k, estado, con_pagos) AS (
  SELECT inscodigo, CAST(0 AS BIGINT), ins_estado, true FROM inscripcion
  UNION ALL
  SELECT p.inscodigo, o.k, CASE WHEN o.decision = 'aprobar' THEN 'conciliado' ELSE 'pendiente' END, p.con_pagos AND o.decision = 'aprobar'
  FROM paso p JOIN orden o ON o.inscodigo = p.inscodigo AND o.k = p.k + 1),
fin AS (SELECT inscodigo, max_by(estado, k) AS estado, bool_and(con_pagos) AS con_pagos FROM paso GROUP BY inscodigo)""").replace(
    "WITH ", "WITH RECURSIVE ", 1)
_TRAS_DECISIONES = f"""{_INS_SEL} (
  SELECT inscodigo, ins_perdoc, ins_oferta, ins_empresa_id, estado AS ins_estado, ins_fecha FROM inscripcion JOIN fin USING (inscodigo)) u"""


def _decisiones(spark, sf):
    t = tablas(spark, sf)
    return K.decidir_pagos(t, t["decision_mixta"])


@consulta("inscripcion_tras_decisiones", _DECISIONES_CTES + _TRAS_DECISIONES)
def _inscripcion_tras_decisiones(spark, sf):
    return como_texto(_decisiones(spark, sf)["inscripcion"])


@consulta("pagos_tras_decisiones", _DECISIONES_CTES + f"""{_PAGO_SEL} pago_reportado
WHERE pago_inscodigo IN (SELECT inscodigo FROM fin WHERE con_pagos)""")
def _pagos_tras_decisiones(spark, sf):
    return como_texto(_decisiones(spark, sf)["pago_reportado"])


_DECISIONES_LOTE_CTES = W("inscripcion", "pago_reportado", "decision_lote_mixta", extra="""
orden AS (SELECT *, row_number() OVER (PARTITION BY empresa_id, oferta ORDER BY en, solicitud_id) AS k FROM decision_lote_mixta),
paso(inscodigo, ins_empresa_id, ins_oferta, k, estado, con_pagos) AS (
  SELECT inscodigo, ins_empresa_id, ins_oferta, CAST(0 AS BIGINT), ins_estado, true FROM inscripcion
  UNION ALL
  SELECT p.inscodigo, p.ins_empresa_id, p.ins_oferta, o.k,
         CASE WHEN o.decision = 'aprobar' THEN 'conciliado' WHEN p.estado = 'en_revision' THEN 'rechazado' ELSE p.estado END,
         p.con_pagos AND NOT (o.decision = 'rechazar' AND p.estado = 'en_revision')
  FROM paso p JOIN orden o ON o.empresa_id = p.ins_empresa_id AND o.oferta = p.ins_oferta AND o.k = p.k + 1),
fin AS (SELECT inscodigo, max_by(estado, k) AS estado, bool_and(con_pagos) AS con_pagos FROM paso GROUP BY inscodigo)""").replace(
    "WITH ", "WITH RECURSIVE ", 1)


def _decisiones_lote(spark, sf):
    t = tablas(spark, sf)
    return K.decidir_lotes_pagos(t, t["decision_lote_mixta"])


@consulta("lotes_tras_decisiones", _DECISIONES_LOTE_CTES + _TRAS_DECISIONES)
def _lotes_tras_decisiones(spark, sf):
    return como_texto(_decisiones_lote(spark, sf)["inscripcion"])


@consulta("pagos_tras_decisiones_lote", _DECISIONES_LOTE_CTES + f"""{_PAGO_SEL} pago_reportado
WHERE pago_inscodigo IN (SELECT inscodigo FROM fin WHERE con_pagos)""")
def _pagos_tras_decisiones_lote(spark, sf):
    return como_texto(_decisiones_lote(spark, sf)["pago_reportado"])


_ELIM_EXTRA = """
hall AS (SELECT inscodigo, ins_perdoc, ins_oferta FROM inscripcion WHERE inscodigo IN (SELECT inscodigo FROM eliminacion))"""
_ELIM_CTES = W("inscripcion", "eliminacion", "pago_reportado", "persona_capacitacion", extra=_ELIM_EXTRA)


def _elim(spark, sf):
    t = tablas(spark, sf)
    return K.eliminar_inscripciones(t, t["eliminacion"])


@consulta("eliminacion_resultado", _ELIM_CTES + """
SELECT DISTINCT e.inscodigo, CASE WHEN h.inscodigo IS NULL THEN 'no_encontrada' ELSE 'ok' END AS motivo
FROM eliminacion e LEFT JOIN hall h ON h.inscodigo = e.inscodigo""")
def _eliminacion_resultado(spark, sf):
    return _elim(spark, sf)["resultado"]


@consulta("inscripcion_tras_eliminar", _ELIM_CTES + f"{_INS_SEL} inscripcion WHERE inscodigo NOT IN (SELECT inscodigo FROM hall)")
def _inscripcion_tras_eliminar(spark, sf):
    return como_texto(_elim(spark, sf)["inscripcion"])


@consulta("pagos_tras_eliminar", _ELIM_CTES + f"{_PAGO_SEL} pago_reportado WHERE pago_inscodigo NOT IN (SELECT inscodigo FROM hall)")
def _pagos_tras_eliminar(spark, sf):
    return como_texto(_elim(spark, sf)["pago_reportado"])


@consulta("academico_tras_eliminar", _ELIM_CTES + """
SELECT pcap_perdoc, pcap_oferta FROM persona_capacitacion pc
WHERE NOT EXISTS (SELECT 1 FROM hall h WHERE h.ins_perdoc = pc.pcap_perdoc AND h.ins_oferta = pc.pcap_oferta)""")
def _academico_tras_eliminar(spark, sf):
    return _elim(spark, sf)["persona_capacitacion"]


# ---------------------------------------------------------------- offers

_OF_SEL = (f"SELECT capofcodigo, capofcapcodigo, {d('capoffecha_inicio')}, {d('capoffecha_fin')}, capofcupos, "
           "capofestatus, cupos_bloqueados FROM")
_MOTIVO_OFERTA = (
    f"CASE WHEN {_vacio('capofcapcodigo')} OR {_vacio('fecha_inicio')} OR {_vacio('fecha_fin')} OR {_vacio('cupos')} "
    "THEN 'faltan_datos' WHEN coalesce(TRY_CAST(CAST(fecha_inicio AS VARCHAR) AS DATE) > "
    "TRY_CAST(CAST(fecha_fin AS VARCHAR) AS DATE), false) THEN 'fechas_invertidas' END"
)
_ILEGIBLE = ("(TRY_CAST(CAST(fecha_inicio AS VARCHAR) AS DATE) IS NULL OR "
             "TRY_CAST(CAST(fecha_fin AS VARCHAR) AS DATE) IS NULL)")
_CREAR_EXTRA = f"ov AS (SELECT b.*, {_MOTIVO_OFERTA} AS motivo, {_ILEGIBLE} AS fecha_ilegible FROM oferta_borrador b)"
_CREAR_CTES = W("oferta_borrador", "capacitacion_oferta", extra=_CREAR_EXTRA)


def _crear(spark, sf):
    t = tablas(spark, sf)
    return K.crear_ofertas(t, t["oferta_borrador"])


@consulta("ofertas_validas", _CREAR_CTES + f"""
SELECT capofcapcodigo, {d('fecha_inicio')}, {d('fecha_fin')}, cupos, coalesce(motivo, 'ok') AS motivo, fecha_ilegible FROM ov""")
def _ofertas_validas(spark, sf):
    return como_texto(_crear(spark, sf)["resultado"])


@consulta("ofertas_tras_crear", _CREAR_CTES + f"""{_OF_SEL} (
  SELECT * FROM capacitacion_oferta
  UNION ALL
  SELECT (SELECT coalesce(max(capofcodigo), 0) FROM capacitacion_oferta)
           + row_number() OVER (ORDER BY capofcapcodigo, fecha_inicio, fecha_fin, cupos),
         capofcapcodigo, fecha_inicio, fecha_fin, cupos, 1, 0
  FROM ov WHERE motivo IS NULL) u""")
def _ofertas_tras_crear(spark, sf):
    return como_texto(_crear(spark, sf)["capacitacion_oferta"])


@consulta("ofertas_tras_editar", W("oferta_edicion", "capacitacion_oferta", extra=f"""
u AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY capofcodigo ORDER BY en DESC, solicitud_id DESC) AS k
                     FROM oferta_edicion e WHERE ({_MOTIVO_OFERTA}) IS NULL) z WHERE k = 1)""") + f"""{_OF_SEL} (
  SELECT co.capofcodigo,
         CASE WHEN u.capofcodigo IS NULL THEN co.capofcapcodigo ELSE u.capofcapcodigo END AS capofcapcodigo,
         CASE WHEN u.capofcodigo IS NULL THEN co.capoffecha_inicio ELSE u.fecha_inicio END AS capoffecha_inicio,
         CASE WHEN u.capofcodigo IS NULL THEN co.capoffecha_fin ELSE u.fecha_fin END AS capoffecha_fin,
         CASE WHEN u.capofcodigo IS NULL THEN co.capofcupos ELSE u.cupos END AS capofcupos,
         co.capofestatus, co.cupos_bloqueados
  FROM capacitacion_oferta co LEFT JOIN u ON u.capofcodigo = co.capofcodigo) x""")
def _ofertas_tras_editar(spark, sf):
    t = tablas(spark, sf)
    return como_texto(K.editar_ofertas(t, t["oferta_edicion"]))


def _toggle_sql(campo: str, col: str) -> str:
    uno = f"(CASE WHEN coalesce(co.{col} = 1, false) THEN 0 ELSE 1 END)"
    nuevo = f"CASE WHEN n.n IS NULL THEN co.{col} WHEN n.n % 2 = 1 THEN {uno} ELSE 1 - {uno} END AS {col}"
    cols = ["co.capofcodigo", "co.capofcapcodigo", "co.capoffecha_inicio", "co.capoffecha_fin", "co.capofcupos",
            "co.capofestatus", "co.cupos_bloqueados"]
    cols = [nuevo if c == f"co.{col}" else c for c in cols]
    return W("toggle_oferta", "capacitacion_oferta") + f"""{_OF_SEL} (
  SELECT {', '.join(cols)} FROM capacitacion_oferta co
  LEFT JOIN (SELECT capofcodigo, COUNT(*) AS n FROM toggle_oferta WHERE campo = '{campo}' GROUP BY capofcodigo) n
    ON n.capofcodigo = co.capofcodigo) x"""


@consulta("ofertas_toggle_estatus", _toggle_sql("estatus", "capofestatus"))
def _ofertas_toggle_estatus(spark, sf):
    t = tablas(spark, sf)
    return como_texto(K.alternar_ofertas(t, t["toggle_oferta"], "estatus"))


@consulta("ofertas_toggle_bloqueo", _toggle_sql("bloqueo", "cupos_bloqueados"))
def _ofertas_toggle_bloqueo(spark, sf):
    t = tablas(spark, sf)
    return como_texto(K.alternar_ofertas(t, t["toggle_oferta"], "bloqueo"))


# ---------------------------------------------------------------- people and contacts

@consulta("persona_tras_editar", W("persona_edicion", "persona", extra=f"""
u AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY doc ORDER BY en DESC, solicitud_id DESC) AS k
                     FROM persona_edicion e
                     WHERE NOT ({_vacio('doc')} OR {_vacio('nombre')} OR {_vacio('apellido')})) z WHERE k = 1)""") + f"""
SELECT p.pertipodoc, p.perdoc, CASE WHEN u.doc IS NULL THEN p.pernombre ELSE u.nombre END AS pernombre,
       CASE WHEN u.doc IS NULL THEN p.perapellido ELSE u.apellido END AS perapellido, {d('p.perfechanac')},
       CASE WHEN u.doc IS NULL THEN p.pertelefono ELSE u.telefono END AS pertelefono, p.peremail, p.perpais, p.perciudad
FROM persona p LEFT JOIN u ON u.doc = p.perdoc""")
def _persona_tras_editar(spark, sf):
    t = tablas(spark, sf)
    return como_texto(K.editar_personas(t, t["persona_edicion"])["persona"])


# The sequential first-wins rule as a recursive query over the requests in arrival order
# (state: documents and e-mails taken so far), independent of the rounds of ``alta_contactos``.
_CONTACTOS_EXTRA = f"""
va AS (SELECT a.*, row_number() OVER (ORDER BY en, solicitud_id) AS k FROM contacto_alta a
       WHERE NOT ({_vacio('empresa_nombre')} OR {_vacio('emp_tipodoc')} OR {_vacio('emp_doc')} OR {_vacio('emp_nombre')} OR {_vacio('emp_apellido')} OR {_vacio('emp_email')} OR {_vacio('emp_telefono')})),
seq(k, docs, mails, solicitud_id, ok) AS (
  SELECT CAST(0 AS BIGINT), (SELECT coalesce(list(emp_doc), CAST([] AS VARCHAR[])) FROM contacto_empresa),
         (SELECT coalesce(list(emp_email), CAST([] AS VARCHAR[])) FROM contacto_empresa), CAST(NULL AS BIGINT), false
  UNION ALL
  SELECT z.k, CASE WHEN z.ok THEN list_append(z.docs, z.emp_doc) ELSE z.docs END,
         CASE WHEN z.ok THEN list_append(z.mails, z.emp_email) ELSE z.mails END, z.solicitud_id, z.ok
  FROM (SELECT v.k, s.docs, s.mails, v.emp_doc, v.emp_email, v.solicitud_id,
               NOT list_contains(s.docs, v.emp_doc) AND NOT list_contains(s.mails, v.emp_email) AS ok
        FROM seq s JOIN va v ON v.k = s.k + 1) z),
nuevos AS (SELECT (SELECT coalesce(max(id_contacto), 0) FROM contacto_empresa)
                  + row_number() OVER (ORDER BY v.en, v.solicitud_id) AS id_contacto, v.*
           FROM va v JOIN seq s ON s.solicitud_id = v.solicitud_id WHERE s.ok)"""
_CONTACTOS_CTES = W("contacto_alta", "contacto_empresa", extra=_CONTACTOS_EXTRA).replace("WITH ", "WITH RECURSIVE ", 1)


@consulta("contactos_tras_alta", _CONTACTOS_CTES + f"""
SELECT id_contacto, empresa_nombre, emp_tipodoc, emp_doc, emp_nombre, emp_apellido, emp_email, emp_telefono,
       {ts('creado_en')} FROM (
  SELECT * FROM contacto_empresa
  UNION ALL
  SELECT id_contacto, empresa_nombre, emp_tipodoc, emp_doc, emp_nombre, emp_apellido, emp_email, emp_telefono, en
  FROM nuevos) u""")
def _contactos_tras_alta(spark, sf):
    """W21 first-wins uniqueness on two keys, computed in exact rounds (the oracle is the
    sequential rule as a recursive query)."""
    t = tablas(spark, sf)
    return como_texto(K.alta_contactos(t, t["contacto_alta"])["contacto_empresa"])
