"""Stand-in domain tables and change sets derived from the driver's Parquet tables.

Each entry is plain SQL that runs unchanged in Spark and in DuckDB, so an oracle query can
inline it as a CTE. ``{name}`` placeholders are filled with DataFrames on the Spark side
(``spark.sql(text, name=df)``) and with plain view names on the DuckDB side. These views only
give rows in the schema the jobs expect; none of them does any of the jobs' work.

The first thirteen come from FIXTURES.md; the ones after ``pago_solicitud`` are further change
sets (OTP requests, lot payments, administrator decisions, edits, toggles, contacts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

# Ordered: a view only names base tables or views defined above it.
VISTAS: dict[str, str] = {
    "persona": """
SELECT CASE WHEN c_custkey % 10 = 0 THEN 'Pas' ELSE 'Ced' END AS pertipodoc,
       CAST(1000000 + c_custkey AS STRING) AS perdoc, 'Cliente' AS pernombre, c_name AS perapellido,
       DATE '1970-01-01' + CAST(c_custkey % 9000 AS INT) AS perfechanac,
       concat('+58 ', CAST(4120000000 + c_custkey AS STRING)) AS pertelefono,
       concat('p', CAST(c_custkey AS STRING), '@example.org') AS peremail,
       n_name AS perpais, c_mktsegment AS perciudad
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "capacitacion": """
SELECT DISTINCT p_size AS capcodigo, concat('Curso ', CAST(p_size AS STRING)) AS capnombre FROM {part}""",
    "capacitacion_oferta": """
SELECT p_partkey AS capofcodigo, p_size AS capofcapcodigo,
       DATE '1996-01-01' + CAST(p_partkey % 365 AS INT) AS capoffecha_inicio,
       DATE '1996-01-01' + CAST(p_partkey % 365 + 30 AS INT) AS capoffecha_fin,
       CAST(20 + (p_partkey * 7) % 200 AS INT) AS capofcupos,
       CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS capofestatus,
       CASE WHEN p_partkey % 7 = 0 THEN 1 WHEN p_partkey % 31 = 30 THEN NULL ELSE 0 END AS cupos_bloqueados
FROM {part}""",
    "contacto_empresa": """
SELECT s_suppkey AS id_contacto, s_name AS empresa_nombre, 'Ced' AS emp_tipodoc,
       CAST(900000 + s_suppkey AS STRING) AS emp_doc, 'Contacto' AS emp_nombre, s_name AS emp_apellido,
       concat('e', CAST(s_suppkey AS STRING), '@example.org') AS emp_email, '+58 4120000000' AS emp_telefono,
       CAST(DATE '1995-01-01' + CAST(s_suppkey % 300 AS INT) AS TIMESTAMP) AS creado_en
FROM {supplier}""",
    "inscripcion": """
SELECT inscodigo, ins_perdoc, ins_oferta, ins_empresa_id, ins_estado, ins_fecha FROM (
  SELECT o_orderkey AS inscodigo, CAST(1000000 + o_custkey AS STRING) AS ins_perdoc, l.oferta AS ins_oferta,
         CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 3 ELSE NULL END AS ins_empresa_id,
         CASE WHEN o_orderstatus = 'F' THEN 'conciliado' WHEN o_orderstatus = 'O' THEN 'pendiente'
              WHEN o_orderkey % 4 = 0 THEN 'rechazado' ELSE 'en_revision' END AS ins_estado,
         o_orderdate AS ins_fecha,
         row_number() OVER (PARTITION BY o_custkey, l.oferta ORDER BY o_orderkey) AS rn
  FROM {orders} JOIN (SELECT l_orderkey, min(l_partkey) - min(l_partkey) % 8 AS oferta
                    FROM {lineitem} GROUP BY l_orderkey) l ON o_orderkey = l.l_orderkey) t
WHERE rn = 1""",
    "persona_capacitacion": """
SELECT ins_perdoc AS pcap_perdoc, ins_oferta AS pcap_oferta FROM {inscripcion}""",
    "pago_reportado": """
SELECT inscodigo AS pago_inscodigo, ins_empresa_id AS pago_empresa_id, 'Titular' AS titular_nombre,
       ins_perdoc AS titular_apellido, '04140000000' AS titular_telefono, 'Banco A' AS banco_origen,
       concat('REF', CAST(inscodigo AS STRING)) AS referencia, ins_fecha + INTERVAL 1 DAY AS fecha_reporte
FROM {inscripcion} WHERE ins_estado IN ('en_revision', 'conciliado')
UNION ALL
SELECT inscodigo, ins_empresa_id, 'Titular', ins_perdoc, '04140000000', 'Banco B',
       concat('DUP', CAST(inscodigo AS STRING)), ins_fecha + INTERVAL 2 DAY
FROM {inscripcion} WHERE ins_estado IN ('en_revision', 'conciliado') AND inscodigo % 50 = 0""",
    "token_otp": """
SELECT event_id AS id_otp, concat('p', CAST(user_id AS STRING), '@example.org') AS email,
       CAST(100000 + event_id % 50 AS STRING) AS codigo, ts + INTERVAL 15 MINUTES AS expira_en,
       CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS usado
FROM {events} WHERE event_type = 'click'""",
    "intento_otp": """
SELECT id_otp AS intento_id, email, CASE WHEN id_otp % 9 = 0 THEN '000000' ELSE codigo END AS codigo,
       CASE WHEN id_otp % 3 = 0 THEN expira_en - INTERVAL 5 MINUTES
            WHEN id_otp % 3 = 1 THEN expira_en ELSE expira_en + INTERVAL 1 MINUTES END AS en
FROM {token_otp}""",
    "solicitud_registro": """
SELECT event_id AS solicitud_id, CASE WHEN event_id % 10 = 0 THEN 'Pas' ELSE 'Ced' END AS tipodoc,
       CASE WHEN event_id % 11 = 0 THEN 'X1' ELSE CAST(1000000 + (event_id * 7) % 3000 AS STRING) END AS doc,
       CASE WHEN event_id % 13 = 0 THEN '' ELSE 'aNA maria' END AS nombre, 'PEREZ' AS apellido,
       CASE WHEN event_id % 19 = 0 THEN '58' ELSE '+58' END AS codpais,
       CASE WHEN event_id % 17 = 0 THEN '12' ELSE CAST(4120000000 + event_id AS STRING) END AS telefono,
       concat('n', CAST(event_id AS STRING), '@example.org') AS email, 'VE' AS pais, 'Caracas' AS ciudad,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE '1990-01-01' END AS fechanac,
       (event_id % 60) * 8 AS capacitacion, ts AS recibido_en
FROM {events} WHERE event_type = 'signup'""",
    "lote_fila": """
SELECT lote_id, fila, lote_id % 3 AS empresa_id,
       CASE WHEN lote_id % 2 = 0 THEN (lote_id % 25) * 8 ELSE (lote_id % 25) * 8 + 3 END AS oferta, 'Ced' AS tipodoc,
       CAST(1000000 + 13 * (fila % 50) + lote_id % 5 AS STRING) AS doc, 'Empleado' AS nombre,
       CAST(fila AS STRING) AS apellido, concat('+58 ', CAST(4240000000 + fila AS STRING)) AS telefono,
       concat('l', CAST(fila AS STRING), '@example.org') AS email, 'VE' AS pais, 'Valencia' AS ciudad,
       '1991-02-03' AS fechanac
FROM (SELECT event_id AS fila, CAST((event_id - event_id % 100) / 100 AS BIGINT) AS lote_id
      FROM {events} WHERE event_type = 'purchase') t""",
    "oferta_borrador": """
SELECT p_size AS capofcapcodigo, DATE '1999-01-01' AS fecha_inicio,
       DATE '1999-01-01' + CAST(p_partkey % 11 - 2 AS INT) AS fecha_fin, CAST(1 + p_partkey % 500 AS INT) AS cupos
FROM {part}""",
    "pago_solicitud": """
SELECT inscodigo AS solicitud_id, inscodigo,
       CASE WHEN inscodigo % 23 = 0 THEN '' ELSE 'Maria' END AS titular_nombre, 'Mendoza' AS titular_apellido,
       '04141234567' AS titular_telefono, 'Banco C' AS banco_origen,
       CAST(100000 + inscodigo % 900000 AS STRING) AS referencia,
       CASE WHEN inscodigo % 29 = 0 THEN 0 ELSE 1 END AS tiene_comprobante
FROM {inscripcion} WHERE ins_estado = 'pendiente'""",
    # --- further change sets ---
    # One-time-code requests of people (cedula = document typed, email = address the code goes to).
    "solicitud_otp": """
SELECT event_id AS solicitud_id, CAST(1000000 + user_id * 11 AS STRING) AS cedula,
       concat('p', CAST(user_id AS STRING), '@example.org') AS email,
       CAST(100000 + (event_id * 37) % 900000 AS STRING) AS codigo, ts AS en
FROM {events} WHERE event_type = 'view'""",
    # One-time-code requests on the company portal: document and e-mail must both match a contact.
    "solicitud_otp_empresa": """
SELECT event_id AS solicitud_id, CAST(900000 + user_id AS STRING) AS cedula,
       concat('e', CAST(CASE WHEN event_id % 4 = 0 THEN user_id + 1 ELSE user_id END AS STRING), '@example.org') AS email,
       CAST(200000 + (event_id * 31) % 700000 AS STRING) AS codigo, ts AS en
FROM {events} WHERE event_type = 'error'""",
    # Codes typed on the company portal one minute after asking (every fifth one mistyped).
    "intento_otp_empresa": """
SELECT solicitud_id AS intento_id, email, CASE WHEN solicitud_id % 5 = 0 THEN '000000' ELSE codigo END AS codigo,
       en + INTERVAL 1 MINUTES AS en
FROM {solicitud_otp_empresa}""",
    # Lot payment reports: one per (company, offer) seen in enrolments, a second one for some lots.
    "pago_lote_solicitud": """
SELECT ins_empresa_id * 100000000 + ins_oferta AS solicitud_id, ins_empresa_id AS empresa_id, ins_oferta AS oferta,
       'Pedro' AS titular_nombre, CASE WHEN ins_oferta % 7 = 0 THEN '' ELSE 'Lopez' END AS titular_apellido,
       '04240000000' AS titular_telefono, 'Banco D' AS banco_origen, concat('L', CAST(ins_oferta AS STRING)) AS referencia,
       1 AS tiene_comprobante
FROM (SELECT DISTINCT ins_empresa_id, ins_oferta FROM {inscripcion} WHERE ins_empresa_id IS NOT NULL) t
UNION ALL
SELECT ins_empresa_id * 100000000 + ins_oferta + 50000000, ins_empresa_id, ins_oferta, 'Pedro', 'Lopez',
       '04240000000', 'Banco E', concat('M', CAST(ins_oferta AS STRING)), 1
FROM (SELECT DISTINCT ins_empresa_id, ins_oferta FROM {inscripcion} WHERE ins_empresa_id IS NOT NULL) t
WHERE ins_oferta % 5 = 0""",
    # Administrator decisions on single enrolments in review (FIXTURES: odd codes approved, even rejected).
    "decision_pago": """
SELECT inscodigo, CASE WHEN inscodigo % 2 = 1 THEN 'aprobar' ELSE 'rechazar' END AS decision
FROM {inscripcion} WHERE ins_estado = 'en_revision'""",
    # Administrator deletions (every 20th code) plus codes that do not exist.
    "eliminacion": """
SELECT inscodigo FROM {inscripcion} WHERE inscodigo % 20 = 0
UNION ALL
SELECT -1 - c_custkey AS inscodigo FROM {customer} WHERE c_custkey % 500 = 7""",
    # Administrator decisions on company lots in review (offer % 16 = 0 approved, = 8 rejected).
    "decision_lote": """
SELECT DISTINCT ins_empresa_id AS empresa_id, ins_oferta AS oferta,
       CASE WHEN ins_oferta % 16 = 0 THEN 'aprobar' ELSE 'rechazar' END AS decision
FROM {inscripcion} WHERE ins_empresa_id IS NOT NULL AND ins_estado = 'en_revision'""",
    # Offer edits: some rows with start after end, some on offers that do not exist.
    "oferta_edicion": """
SELECT event_id AS solicitud_id, CAST(user_id * 13 AS BIGINT) AS capofcodigo, CAST(1 + event_id % 50 AS INT) AS capofcapcodigo,
       DATE '2000-01-01' AS fecha_inicio, DATE '2000-01-01' + CAST(event_id % 9 - 2 AS INT) AS fecha_fin,
       CAST(10 + event_id % 90 AS INT) AS cupos, ts AS en
FROM {events} WHERE event_type = 'error'""",
    # Active-flag and seat-block toggles (an offer may be toggled several times in one batch).
    "toggle_oferta": """
SELECT event_id AS solicitud_id, CAST(user_id * 8 AS BIGINT) AS capofcodigo,
       CASE WHEN event_id % 2 = 0 THEN 'estatus' ELSE 'bloqueo' END AS campo, ts AS en
FROM {events} WHERE event_type = 'click'""",
    # Administrator profile edits (name, surname, phone) keyed by document.
    "persona_edicion": """
SELECT event_id AS solicitud_id, CAST(1000000 + user_id * 3 AS STRING) AS doc,
       CASE WHEN event_id % 9 = 0 THEN '' ELSE 'Editado' END AS nombre,
       concat('Apellido', CAST(event_id AS STRING)) AS apellido, '+58 4140000000' AS telefono, ts AS en
FROM {events} WHERE event_type = 'purchase'""",
    # Quick enrolments of people who already have an account (document + offer only).
    "solicitud_rapida": """
SELECT event_id AS solicitud_id, CAST(1000000 + user_id * 7 AS STRING) AS cedula,
       CASE WHEN event_id % 37 = 0 THEN NULL ELSE (event_id % 40) * 8 END AS capacitacion, ts AS en
FROM {events} WHERE event_type = 'view'""",
    # New company contacts; documents and e-mails collide with existing contacts and each other.
    "contacto_alta": """
SELECT event_id AS solicitud_id, concat('Empresa ', CAST(user_id AS STRING)) AS empresa_nombre, 'Rif' AS emp_tipodoc,
       CAST(900000 + user_id * 2 AS STRING) AS emp_doc, 'Ana' AS emp_nombre, 'Ruiz' AS emp_apellido,
       concat('e', CAST(user_id * 3 AS STRING), '@example.org') AS emp_email,
       CASE WHEN event_id % 13 = 0 THEN '' ELSE '+58 4140000000' END AS emp_telefono, ts AS en
FROM {events} WHERE event_type = 'signup'""",
    # Lots sent from the company portal around each typed code: before it, soon after, just inside and just past the
    # session's life, and long after; some for another company or for one that is no contact.
    "envio_lote": """
SELECT intento_id * 8 + j AS lote_id,
       CASE WHEN intento_id % 11 = 0 THEN u + 1000000 WHEN intento_id % 6 = 0 THEN u + 1 ELSE u END AS empresa_id,
       (intento_id % 25) * 8 AS oferta,
       CASE WHEN intento_id % 2 = 0 OR intento_id % 11 = 0 THEN email END AS sesion_email,
       CASE WHEN j = 0 THEN en - INTERVAL 2 MINUTES WHEN j = 1 THEN en + INTERVAL 5 MINUTES WHEN j = 2 THEN en + INTERVAL 119 MINUTES
            WHEN j = 3 THEN en + INTERVAL 120 MINUTES ELSE en + INTERVAL 300 MINUTES END AS en
FROM (SELECT intento_id, email, en, CAST(split_part(substr(email, 2), '@', 1) AS BIGINT) AS u FROM {intento_otp_empresa}) i,
     (VALUES (0), (1), (2), (3), (4)) AS v(j)""",
    # Lot rows as the page may post them: blank names, missing dates, spaces to trim.
    "lote_fila_pagina": """
SELECT lote_id, fila, empresa_id, oferta, tipodoc, doc, CASE WHEN fila % 97 = 0 THEN '  ' ELSE nombre END AS nombre,
       concat(' ', apellido, ' ') AS apellido, telefono, email, pais, ciudad, CASE WHEN fila % 89 = 0 THEN NULL ELSE fechanac END AS fechanac
FROM {lote_fila}""",
    # What people type on the registration page: spaces around, phones with leading zeros.
    "entrada_pagina": """
SELECT solicitud_id, concat('  ', doc, ' ') AS cedula, concat(email, ' ') AS email,
       CASE WHEN solicitud_id % 3 = 0 THEN concat('00', telefono) ELSE telefono END AS telefono
FROM {solicitud_registro}""",
    # Lots without employees; every fifth one without a readable company.
    "lote_vacio": """
SELECT CAST(1000000 + s_suppkey AS STRING) AS lote_id, CASE WHEN s_suppkey % 5 = 0 THEN 'x' ELSE CAST(s_suppkey AS STRING) END AS empresa_id,
       '8' AS oferta
FROM {supplier}""",
    # Lines that are no JSON record, among the registration requests.
    "linea_rota": """
SELECT concat('no es un registro ', CAST(event_id AS STRING)) AS linea FROM {events} WHERE event_type = 'error'""",
    # Several decisions for one enrolment, or one lot, in one batch.
    "decision_mixta": """
SELECT event_id AS solicitud_id, CAST(user_id AS BIGINT) AS inscodigo, CASE WHEN event_id % 3 = 0 THEN 'rechazar' ELSE 'aprobar' END AS decision, ts AS en
FROM {events} WHERE event_type = 'view'""",
    "decision_lote_mixta": """
SELECT event_id AS solicitud_id, CAST(user_id % 3 AS BIGINT) AS empresa_id, CAST((event_id % 12) * 8 AS BIGINT) AS oferta,
       CASE WHEN event_id % 5 = 0 THEN 'aprobar' ELSE 'rechazar' END AS decision, ts AS en
FROM {events} WHERE event_type = 'error'""",
}


def _nombres(texto: str) -> list[str]:
    import re

    return sorted(set(re.findall(r"\{(\w+)\}", texto)))


def sql_duckdb(nombre: str) -> str:
    """The view's SQL with plain table names, as DuckDB runs it."""
    texto = VISTAS[nombre]
    return texto.format(**{n: n for n in _nombres(texto)}).strip()


def ctes(*nombres: str) -> str:
    """``WITH`` list defining the given views and everything they depend on, in order."""
    necesarias: set[str] = set()

    def visitar(n: str) -> None:
        if n in BASE or n in necesarias:
            return
        for dep in _nombres(VISTAS[n]):
            visitar(dep)
        necesarias.add(n)

    for n in nombres:
        visitar(n)
    orden = [n for n in VISTAS if n in necesarias]
    return "WITH " + ",\n".join(f"{n} AS ({sql_duckdb(n)})" for n in orden)


def leer_base(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE}


class Tablas(dict):
    """Lazy name -> DataFrame map of the domain tables and change sets for one data folder."""

    def __init__(self, spark: SparkSession, base: dict[str, DataFrame]):
        super().__init__()
        self.spark = spark
        self.base = base

    def __missing__(self, nombre: str) -> DataFrame:
        if nombre in self.base:
            return self.base[nombre]
        if nombre not in VISTAS:
            raise KeyError(nombre)
        texto = VISTAS[nombre]
        df = self.spark.sql(texto, **{n: self[n] for n in _nombres(texto)})
        self[nombre] = df
        return df


def cargar(spark: SparkSession, sf_dir: str) -> Tablas:
    """Domain tables and change sets derived from the Parquet tables in ``sf_dir``."""
    return Tablas(spark, leer_base(spark, sf_dir))


def desde_dataframes(spark: SparkSession, tablas: dict[str, DataFrame]) -> Tablas:
    """Wrap already-built domain tables (tests, snapshots) in the same lazy map."""
    t = Tablas(spark, {})
    t.update(tablas)
    return t
