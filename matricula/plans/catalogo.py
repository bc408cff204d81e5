"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per SURVEY §2 key, with the
equivalent DuckDB SQL where the operator is expressible in SQL.

The callables read the driver's tables in ``sf_dir`` through ``preparacion.cargar`` (stand-in
domain tables and change sets) and then run the library operator on the whole of them.
Temporal outputs are rendered as ISO text (``como_texto``) so both engines hash the same values.
"""

from __future__ import annotations

import uuid

from ..operators import consultas as C
from ..sesion import asegurar_checkpoint
from ..sources import almacen
from .registro import ORACULO, W, consulta, tablas
from .texto import como_texto, d, ts

# ---------------------------------------------------------------- reads (J, A, O)

# Building blocks of the oracles: offers with the name of their course, seats taken per offer, people
# on each enrolment, readable payment reports.
_CURSO = """oferta_curso AS (
  SELECT capofcodigo, capnombre, capoffecha_inicio, capoffecha_fin, capofcupos, capofestatus, cupos_bloqueados
  FROM capacitacion_oferta, capacitacion WHERE capcodigo = capofcapcodigo)"""
_OCUPADOS = """ocupacion AS (
  SELECT capofcodigo, (SELECT count(*) FROM inscripcion WHERE ins_oferta = capofcodigo) AS ocupados FROM capacitacion_oferta)"""
_ALUMNO = """alumno AS (
  SELECT ins.*, quien.* FROM persona AS quien INNER JOIN inscripcion AS ins ON quien.perdoc = ins.ins_perdoc)"""
_OFERTAS = ("capacitacion_oferta", "capacitacion", "inscripcion")


@consulta("ofertas_activas", W(*_OFERTAS, extra=f"{_CURSO},\n{_OCUPADOS}") + """
SELECT capofcodigo, capnombre, cupos_bloqueados, capofcupos - ocupados AS cupos_restantes
FROM (SELECT * FROM oferta_curso WHERE capofestatus = 1) INNER JOIN ocupacion USING (capofcodigo)""")
def _ofertas_activas(spark, sf):
    return C.ofertas_activas(tablas(spark, sf))


@consulta("ofertas_disponibles", ORACULO["ofertas_activas"])
def _ofertas_disponibles(spark, sf):
    return C.ofertas_disponibles(tablas(spark, sf))


@consulta("ofertas_panel", W("capacitacion_oferta", "capacitacion", extra=_CURSO) + """
SELECT capofcodigo, capnombre, capofcupos FROM oferta_curso WHERE capofestatus = 1""")
def _ofertas_panel(spark, sf):
    return C.ofertas_panel(tablas(spark, sf))


@consulta("ofertas_todas", W(*_OFERTAS, extra=f"{_CURSO},\n{_OCUPADOS}") + f"""
SELECT capofcodigo, capnombre, {d('capoffecha_inicio')}, {d('capoffecha_fin')}, capofcupos, capofestatus, cupos_bloqueados,
       ocupados AS inscritos
FROM oferta_curso INNER JOIN ocupacion USING (capofcodigo) ORDER BY capofcodigo DESC""")
def _ofertas_todas(spark, sf):
    return como_texto(C.ofertas_todas(tablas(spark, sf)))


@consulta("ofertas_etiquetas", W(*_OFERTAS, extra=f"{_CURSO},\n{_OCUPADOS}" + """,
estado AS (
  SELECT *, coalesce(cupos_bloqueados = 1, false) AS cerrada, coalesce(capofestatus = 1, false) AS activa,
         CASE WHEN capofestatus = 1 THEN capofcupos - ocupados END AS libres
  FROM oferta_curso INNER JOIN ocupacion USING (capofcodigo))""") + """
SELECT capofcodigo,
       strftime(capoffecha_inicio, '%-d/%-m/%Y') AS inicio_texto, strftime(capoffecha_fin, '%-d/%-m/%Y') AS fin_texto,
       ocupados AS inscritos, if(activa, 'ACTIVA', 'INACTIVA') AS etiqueta_estatus, if(cerrada, 'CERRADO', NULL) AS etiqueta_bloqueo,
       CASE WHEN cerrada THEN 'CERRADO' WHEN libres <= 0 THEN 'AGOTADO' END AS etiqueta_cupos,
       greatest(0, libres) AS cupos_visibles, cerrada OR coalesce(libres <= 0, false) AS deshabilitada
FROM estado""")
def _ofertas_etiquetas(spark, sf):
    return C.ofertas_etiquetas(tablas(spark, sf))


@consulta("cursos_pendientes", W("inscripcion", "capacitacion_oferta", "capacitacion", extra=_CURSO + """,
por_pagar AS (SELECT ins_perdoc, inscodigo, ins_oferta AS capofcodigo FROM inscripcion WHERE ins_estado = 'pendiente')""") + """
SELECT ins_perdoc, inscodigo, capnombre FROM por_pagar INNER JOIN oferta_curso USING (capofcodigo)""")
def _cursos_pendientes(spark, sf):
    return C.cursos_pendientes(tablas(spark, sf))


# The texts of the options in the pages' lists.
@consulta("opciones_ofertas", W(*_OFERTAS, extra=_CURSO) + """
SELECT capofcodigo, format('{} (Código: {})', capnombre, capofcodigo) AS opcion FROM oferta_curso WHERE capofestatus = 1""")
def _opciones_ofertas(spark, sf):
    return C.opciones_ofertas(tablas(spark, sf))


@consulta("opciones_cursos", W("inscripcion", "capacitacion_oferta", "capacitacion", extra=_CURSO) + """
SELECT ins_perdoc, inscodigo, format('{} (Inscripción #{})', capnombre, inscodigo) AS opcion
FROM inscripcion INNER JOIN oferta_curso ON ins_oferta = capofcodigo WHERE ins_estado = 'pendiente'""")
def _opciones_cursos(spark, sf):
    return C.opciones_cursos(tablas(spark, sf))


@consulta("opciones_lotes", W("inscripcion", "capacitacion_oferta", "capacitacion", extra=_CURSO) + """
SELECT ins_empresa_id, capofcodigo, format('{} (Lote #{})', capnombre, capofcodigo) AS opcion
FROM inscripcion INNER JOIN oferta_curso ON ins_oferta = capofcodigo
WHERE ins_empresa_id IS NOT NULL AND ins_estado IN ('pendiente', 'rechazado') GROUP BY ALL""")
def _opciones_lotes(spark, sf):
    return C.opciones_lotes(tablas(spark, sf))


# People of the lots that companies sent, one row per enrolment.
_DE_LOTE = W("inscripcion", "persona", extra=_ALUMNO + """,
de_lote AS (
  SELECT ins_empresa_id, ins_oferta, perdoc, pertipodoc, pernombre, perapellido, pertelefono, peremail, perpais, perciudad, perfechanac,
         coalesce(pertelefono, '') AS tlf, instr(coalesce(pertelefono, ''), ' ') AS espacio
  FROM alumno WHERE ins_empresa_id IS NOT NULL)""")


@consulta("lote_existente", _DE_LOTE + f"SELECT * EXCLUDE (tlf, espacio) REPLACE ({d('perfechanac')}) FROM de_lote")
def _lote_existente(spark, sf):
    return como_texto(C.lote_existente(tablas(spark, sf)))


@consulta("lote_existente_telefono", _DE_LOTE + """
SELECT ins_empresa_id, ins_oferta, perdoc, if(espacio = 0, '+58', left(tlf, espacio - 1)) AS codpais,
       if(espacio = 0, tlf, tlf[espacio + 1:]) AS numero, strftime(perfechanac, '%Y-%m-%d') AS fechanac_iso
FROM de_lote""")
def _lote_existente_telefono(spark, sf):
    return C.lote_existente_telefono(tablas(spark, sf))


_GRID_VISTAS = ("inscripcion", "persona", "capacitacion_oferta", "capacitacion", "pago_reportado", "contacto_empresa")
_SIN_NOMBRE = "coalesce(nullif(empresa_nombre, ''), 'SIN_EMPRESA')"
# One row per enrolment and payment report, with its course and company name.
_GRID = W(*_GRID_VISTAS, extra=f"{_CURSO},\n{_ALUMNO}" + """,
reporte AS (
  SELECT pago_inscodigo AS inscodigo, titular_nombre, titular_apellido, banco_origen, referencia, titular_telefono AS tlf_pago,
         strftime(fecha_reporte, '%d/%m/%Y %I:%M %p') AS fecha_pago FROM pago_reportado),
empresa AS (SELECT id_contacto AS ins_empresa_id, empresa_nombre FROM contacto_empresa),
con_curso AS (SELECT alumno.*, oferta_curso.capnombre FROM oferta_curso INNER JOIN alumno ON ins_oferta = capofcodigo),
grid AS (
  SELECT *, strftime(ins_fecha, '%d/%m/%Y') AS fecha_formateada
  FROM con_curso LEFT JOIN empresa USING (ins_empresa_id) LEFT JOIN reporte USING (inscodigo))""")
_GRID_COLUMNAS = ", ".join(C.COLUMNAS_PARTICIPANTES)


@consulta("participantes", _GRID + f"SELECT {_GRID_COLUMNAS} FROM grid ORDER BY ins_fecha DESC, inscodigo DESC")
def _participantes(spark, sf):
    return C.participantes(tablas(spark, sf))


# A fixed, realistic filter combination of the grid page: pending people without a company.
FILTRO_GRID = {"estado": "pendiente", "empresa": "SIN_EMPRESA", "capacitacion": ""}


@consulta("participantes_filtrados", _GRID + f"""
SELECT {_GRID_COLUMNAS} FROM grid WHERE ins_estado = 'pendiente' AND {_SIN_NOMBRE} = 'SIN_EMPRESA'""")
def _participantes_filtrados(spark, sf):
    return C.participantes_filtrados(C.participantes(tablas(spark, sf)), **FILTRO_GRID)


@consulta("participantes_de_un_curso", _GRID + f"SELECT {_GRID_COLUMNAS} FROM grid WHERE capnombre = 'Curso 7'")
def _participantes_de_un_curso(spark, sf):
    """P10 with the course filter alone."""
    return C.participantes_filtrados(C.participantes(tablas(spark, sf)), capacitacion="Curso 7")


@consulta("participantes_en_cubos", ORACULO["participantes"])
def _participantes_en_cubos(spark, sf):
    """J7 over bucketed tables."""
    t = tablas(spark, sf)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return C.participantes(almacen.en_cubos(spark, t, f"{asegurar_checkpoint(spark)}/cubos-{uuid.uuid4().hex}", n))


@consulta("participantes_etiquetas", _GRID + f"""
SELECT inscodigo, referencia, {_SIN_NOMBRE} AS empresa, pernombre || ' ' || perapellido AS nombre_completo,
       coalesce(map {{'pendiente': 'Pendiente', 'en_revision': 'En Revisión', 'conciliado': 'Conciliado'}}[ins_estado], 'Rechazado') AS etiqueta_estado
FROM grid""")
def _participantes_etiquetas(spark, sf):
    return C.participantes_etiquetas(tablas(spark, sf))


@consulta("cursos_unicos", _GRID + "SELECT capnombre FROM grid WHERE capnombre <> '' GROUP BY capnombre")
def _cursos_unicos(spark, sf):
    return C.cursos_unicos(C.participantes_base(tablas(spark, sf)))


@consulta("empresas_unicas", _GRID + "SELECT empresa_nombre FROM grid WHERE empresa_nombre <> '' GROUP BY empresa_nombre")
def _empresas_unicas(spark, sf):
    return C.empresas_unicas(tablas(spark, sf))


_CORREO_VISTAS = ("inscripcion", "persona", "capacitacion_oferta", "capacitacion")
_CORREO = f"{_CURSO},\n{_ALUMNO}" + """,
correo AS (
  SELECT inscodigo, ins_empresa_id, ins_oferta, peremail, pernombre, capnombre
  FROM oferta_curso INNER JOIN alumno ON ins_oferta = capofcodigo)"""


@consulta("datos_correo", W(*_CORREO_VISTAS, extra=_CORREO) + "SELECT inscodigo, peremail, pernombre, capnombre FROM correo")
def _datos_correo(spark, sf):
    return C.datos_correo(tablas(spark, sf))


@consulta("correos_lote", W(*_CORREO_VISTAS, extra=_CORREO) + "SELECT * EXCLUDE (inscodigo) FROM correo WHERE ins_empresa_id IS NOT NULL")
def _correos_lote(spark, sf):
    return C.correos_lote(tablas(spark, sf))


@consulta("lotes_pendientes", W("inscripcion", "contacto_empresa", "capacitacion_oferta", "capacitacion", extra=_CURSO + """,
en_revision AS (
  SELECT ins_empresa_id AS id_contacto, ins_oferta AS capofcodigo, count(*) AS total_empleados
  FROM inscripcion WHERE ins_estado = 'en_revision' GROUP BY ALL)""") + """
SELECT id_contacto, empresa_nombre, emp_email, capofcodigo, capnombre, total_empleados
FROM en_revision INNER JOIN oferta_curso USING (capofcodigo) INNER JOIN contacto_empresa USING (id_contacto)""")
def _lotes_pendientes(spark, sf):
    return C.lotes_pendientes(tablas(spark, sf))


@consulta("lotes_empresa_pendientes", W("inscripcion", "capacitacion_oferta", "capacitacion", extra=_CURSO + """,
por_pagar AS (
  SELECT ins_empresa_id, ins_oferta AS capofcodigo FROM inscripcion
  WHERE ins_empresa_id IS NOT NULL AND list_contains(['pendiente', 'rechazado'], ins_estado) GROUP BY ALL)""") + """
SELECT ins_empresa_id, capofcodigo, capnombre FROM por_pagar INNER JOIN oferta_curso USING (capofcodigo)""")
def _lotes_empresa_pendientes(spark, sf):
    return C.lotes_empresa_pendientes(tablas(spark, sf))


@consulta("estadisticas", W("capacitacion_oferta", "inscripcion", extra="""
de_ofertas AS (SELECT count_if(capofestatus = 1) AS totalOfertas FROM capacitacion_oferta),
de_inscripciones AS (
  SELECT count_if(ins_estado = 'pendiente') AS totalPendientes, count_if(ins_estado = 'conciliado') AS totalConciliados FROM inscripcion)""") + """
SELECT CAST(totalOfertas AS BIGINT) AS totalOfertas, CAST(totalPendientes AS BIGINT) AS totalPendientes,
       CAST(totalConciliados AS BIGINT) AS totalConciliados FROM de_ofertas, de_inscripciones""")
def _estadisticas(spark, sf):
    return C.estadisticas(tablas(spark, sf))


@consulta("contactos_empresa", W("contacto_empresa") + f"""
SELECT id_contacto, empresa_nombre, emp_tipodoc, emp_doc, emp_nombre, emp_apellido, emp_email, emp_telefono,
       {ts('creado_en')} FROM contacto_empresa ORDER BY creado_en DESC, id_contacto DESC""")
def _contactos_empresa(spark, sf):
    return como_texto(C.contactos_empresa(tablas(spark, sf)))


@consulta("contactos_etiquetas", W("contacto_empresa") + """
SELECT id_contacto, emp_tipodoc || '-' || emp_doc AS documento, empresa_nombre,
       emp_nombre || ' ' || emp_apellido AS representante, emp_email, strftime(creado_en, '%-d/%-m/%Y') AS fecha_registro
FROM contacto_empresa ORDER BY creado_en DESC, id_contacto DESC""")
def _contactos_etiquetas(spark, sf):
    return C.contactos_etiquetas(tablas(spark, sf))


@consulta("capacitaciones_base", W("capacitacion") + "SELECT capcodigo, capnombre FROM capacitacion ORDER BY capnombre")
def _capacitaciones_base(spark, sf):
    return C.capacitaciones_base(tablas(spark, sf))


# ---------------------------------------------------------------- lookups in batch form

@consulta("persona_por_doc", W("persona", "solicitud_otp") + """
SELECT q.cedula, p.pernombre, p.perapellido
FROM (SELECT DISTINCT cedula FROM solicitud_otp) q JOIN persona p ON q.cedula = p.perdoc""")
def _persona_por_doc(spark, sf):
    t = tablas(spark, sf)
    return C.persona_por_doc(t, t["solicitud_otp"])


@consulta("clasifica_nuevos", W("persona", "solicitud_otp") + """
SELECT q.solicitud_id, q.cedula, p.perdoc IS NULL AS es_nuevo,
       CASE WHEN p.perdoc IS NOT NULL THEN coalesce(p.pernombre, 'null') || ' ' || coalesce(p.perapellido, 'null') END AS nombre
FROM solicitud_otp q LEFT JOIN persona p ON q.cedula = p.perdoc""")
def _clasifica_nuevos(spark, sf):
    t = tablas(spark, sf)
    return C.clasifica_nuevos(t, t["solicitud_otp"])


@consulta("contactos_autorizados", W("contacto_empresa", "solicitud_otp_empresa") + """
SELECT q.solicitud_id, q.cedula, q.email, ce.id_contacto
FROM solicitud_otp_empresa q
JOIN (SELECT emp_doc, emp_email, min(id_contacto) AS id_contacto FROM contacto_empresa GROUP BY emp_doc, emp_email) ce
  ON q.cedula = ce.emp_doc AND q.email = ce.emp_email""")
def _contactos_autorizados(spark, sf):
    t = tablas(spark, sf)
    return C.contactos_autorizados(t, t["solicitud_otp_empresa"])


@consulta("oferta_por_id", W("capacitacion_oferta", "oferta_edicion") + f"""
SELECT capofcodigo, capofcapcodigo, {d('capoffecha_inicio')}, {d('capoffecha_fin')}, capofcupos, capofestatus,
       cupos_bloqueados
FROM capacitacion_oferta WHERE capofcodigo IN (SELECT capofcodigo FROM oferta_edicion)""")
def _oferta_por_id(spark, sf):
    t = tablas(spark, sf)
    return como_texto(C.oferta_por_id(t, t["oferta_edicion"]))


@consulta("info_empresa", W("contacto_empresa", "decision_lote") + """
SELECT q.empresa_id, ce.emp_email, ce.empresa_nombre
FROM (SELECT DISTINCT empresa_id FROM decision_lote) q LEFT JOIN contacto_empresa ce ON q.empresa_id = ce.id_contacto""")
def _info_empresa(spark, sf):
    t = tablas(spark, sf)
    return C.info_empresa(t, t["decision_lote"])


@consulta("lote_codigos_pendientes", W("inscripcion", "pago_lote_solicitud") + """
SELECT i.ins_empresa_id, i.ins_oferta, i.inscodigo FROM inscripcion i
WHERE i.ins_estado IN ('pendiente', 'rechazado')
  AND EXISTS (SELECT 1 FROM pago_lote_solicitud s WHERE s.empresa_id = i.ins_empresa_id AND s.oferta = i.ins_oferta)""")
def _lote_codigos_pendientes(spark, sf):
    t = tablas(spark, sf)
    return C.lote_codigos_pendientes(t, t["pago_lote_solicitud"])


@consulta("lote_codigos_en_revision", W("inscripcion", "decision_lote") + """
SELECT i.ins_empresa_id, i.ins_oferta, i.inscodigo FROM inscripcion i
WHERE i.ins_estado = 'en_revision'
  AND EXISTS (SELECT 1 FROM decision_lote s WHERE s.empresa_id = i.ins_empresa_id AND s.oferta = i.ins_oferta)""")
def _lote_codigos_en_revision(spark, sf):
    t = tablas(spark, sf)
    return C.lote_codigos_en_revision(t, t["decision_lote"])
