"""Change jobs W9-W21 and OTP (A7, W7, W8) on hand-built edge tables."""

import random

from fabrica import inscripcion, oferta, persona, tablas, ts
from pyspark.sql import types as T

from matricula.operators import cambios as K
from matricula.operators import consultas as C
from matricula.operators import otp as O

S, L_ = T.StringType(), T.LongType()


def esq(*campos):
    return T.StructType([T.StructField(n, t) for n, t in campos])


def test_grilla_abanico_d12_y_filtros(spark):
    t = tablas(
        spark,
        persona=[persona("1")], capacitacion=[(1, "Curso 1")], capacitacion_oferta=[oferta(1, 5)],
        inscripcion=[inscripcion(1, "1", 1, estado="en_revision"), inscripcion(2, "1", 1, empresa=7)],
        pago_reportado=[(1, None, "T", "A", "0414", "B", "R1", ts("2026-01-02 00:05:00")),
                        (1, None, "T", "A", "0414", "B", "R2", ts("2026-01-02 13:05:00"))],
        contacto_empresa=[(7, "Acme", "Rif", "9", "A", "B", "e@x", "1", ts("2024-01-01 00:00:00"))],
    )
    grid = C.participantes(t).collect()
    assert [r.inscodigo for r in grid].count(1) == 2  # two reports, two rows
    assert {r.fecha_pago for r in grid if r.inscodigo == 1} == {"02/01/2026 12:05 AM", "02/01/2026 01:05 PM"}
    f = C.participantes_filtrados(C.participantes(t), estado="todas", empresa="SIN_EMPRESA")
    assert sorted(r.inscodigo for r in f.collect()) == [1, 1]


def test_toggles_d14_y_fechas_d15(spark):
    t = tablas(spark, capacitacion_oferta=[oferta(1, 5, estatus=1), oferta(2, 5, estatus=None), oferta(3, 5, estatus=0)])
    tg = spark.createDataFrame([(1, 1, "estatus", None), (2, 2, "estatus", None), (3, 3, "estatus", None),
                                (4, 3, "estatus", None), (5, 9, "estatus", None)],
                               esq(("solicitud_id", L_), ("capofcodigo", L_), ("campo", S), ("en", T.TimestampType())))
    got = {r.capofcodigo: r.capofestatus for r in K.alternar_ofertas(t, tg, "estatus").collect()}
    assert got == {1: 0, 2: 1, 3: 0}  # null -> 1; toggled twice: 0 -> 1 -> 0
    import datetime as dt
    b = spark.createDataFrame([(1, dt.date(2024, 1, 1), dt.date(2024, 1, 1), 5), (1, dt.date(2024, 1, 2), dt.date(2024, 1, 1), 5),
                               (None, dt.date(2024, 1, 1), dt.date(2024, 1, 2), 5)],
                              "capofcapcodigo int, fecha_inicio date, fecha_fin date, cupos int")
    r = K.crear_ofertas(t, b)
    assert [x.motivo for x in r["resultado"].collect()] == ["ok", "fechas_invertidas", "faltan_datos"]
    nuevas = r["capacitacion_oferta"].where("capofcodigo > 3").collect()
    assert [(x.capofcodigo, x.capofestatus) for x in nuevas] == [(4, 1)]


def test_pagos_y_decisiones(spark):
    t = tablas(
        spark,
        inscripcion=[inscripcion(1, "a", 1, estado="conciliado"), inscripcion(2, "b", 1, empresa=5),
                     inscripcion(3, "c", 1, empresa=5, estado="rechazado"), inscripcion(4, "d", 1, empresa=5, estado="en_revision"),
                     inscripcion(5, "e", 2, empresa=6, estado="conciliado")],
        pago_reportado=[(4, 5, "T", "A", "0", "B", "R", ts("2024-01-01 00:00:00"))],
    )
    # W9 on an already reconciled enrolment still moves it to review.
    ps = spark.createDataFrame([(1, 1, "M", "L", "0", "B", "R9", 1), (2, 2, "", "L", "0", "B", "R", 1)],
                               esq(("solicitud_id", L_), ("inscodigo", L_), ("titular_nombre", S), ("titular_apellido", S),
                                   ("titular_telefono", S), ("banco_origen", S), ("referencia", S), ("tiene_comprobante", T.IntegerType())))
    r = K.reportar_pagos(t, ps, "2024-02-01 00:00:00")
    assert {x.inscodigo: x.ins_estado for x in r["inscripcion"].collect()}[1] == "en_revision"
    assert {x.solicitud_id: x.motivo for x in r["resultado"].collect()} == {1: "ok", 2: "faltan_datos"}
    # First report of lot (5, 1) takes codes 2 and 3; the second finds none; lot (6, 2) has none.
    pl = spark.createDataFrame([(10, 5, 1, "P", "L", "0", "B", "X", 1), (11, 5, 1, "P", "L", "0", "B", "Y", 1),
                                (12, 6, 2, "P", "L", "0", "B", "Z", 1)],
                               esq(("solicitud_id", L_), ("empresa_id", L_), ("oferta", L_), ("titular_nombre", S),
                                   ("titular_apellido", S), ("titular_telefono", S), ("banco_origen", S), ("referencia", S),
                                   ("tiene_comprobante", T.IntegerType())))
    r = K.reportar_pagos_lote(t, pl, "2024-02-01 00:00:00")
    assert {x.solicitud_id: (x.motivo, x.empleados) for x in r["resultado"].collect()} == \
        {10: ("ok", 2), 11: ("sin_pendientes", 0), 12: ("sin_pendientes", 0)}
    assert sorted(x.pago_inscodigo for x in r["pago_reportado"].collect()) == [2, 3, 4]
    # Lot (5, 1) has code 4 in review; lot (6, 2) has none -> refused, nothing changes.
    lotes = spark.createDataFrame([(5, 1), (6, 2)], "empresa_id long, oferta long")
    r = K.rechazar_lotes(t, lotes)
    assert {(x.empresa_id, x.motivo) for x in r["resultado"].collect()} == {(5, "ok"), (6, "sin_en_revision")}
    assert r["pago_reportado"].count() == 0
    assert {x.inscodigo: x.ins_estado for x in r["inscripcion"].collect()}[4] == "rechazado"
    # W13 approves every enrolment of the lot whatever its state (D3).
    est = {x.inscodigo: x.ins_estado for x in K.aprobar_lotes(t, lotes.where("empresa_id = 5")).collect()}
    assert est == {1: "conciliado", 2: "conciliado", 3: "conciliado", 4: "conciliado", 5: "conciliado"}
    # W12 single rejection goes back to pendiente (D2) and drops the report.
    r = K.rechazar_pagos(t, spark.createDataFrame([(4,)], "inscodigo long"))
    assert r["pago_reportado"].count() == 0
    assert {x.inscodigo: x.ins_estado for x in r["inscripcion"].collect()}[4] == "pendiente"


def test_eliminar_en_cascada(spark):
    t = tablas(
        spark,
        inscripcion=[inscripcion(1, "a", 1), inscripcion(2, "a", 2)],
        persona_capacitacion=[("a", 1), ("a", 1), ("a", 2)],
        pago_reportado=[(1, None, "T", "A", "0", "B", "R", ts("2024-01-01 00:00:00"))],
    )
    r = K.eliminar_inscripciones(t, spark.createDataFrame([(1,), (99,)], "inscodigo long"))
    assert {x.inscodigo: x.motivo for x in r["resultado"].collect()} == {1: "ok", 99: "no_encontrada"}
    assert [x.inscodigo for x in r["inscripcion"].collect()] == [2]
    assert [(x.pcap_perdoc, x.pcap_oferta) for x in r["persona_capacitacion"].collect()] == [("a", 2)]
    assert r["pago_reportado"].count() == 0


def _modelo_contactos(existentes, altas):
    docs = {d for d, _ in existentes}
    mails = {m for _, m in existentes}
    out = {}
    for sid, doc, mail in altas:
        if doc in docs or mail in mails:
            out[sid] = "duplicado"
        else:
            out[sid] = "ok"
            docs.add(doc)
            mails.add(mail)
    return out


def test_contactos_igual_al_modelo_con_cadenas(spark):
    rnd = random.Random(3)
    existentes = [("D0", "m0")]
    altas = [(i, f"D{rnd.randint(0, 6)}", f"m{rnd.randint(0, 6)}") for i in range(30)]
    ce = [(0, "E0", "Rif", "D0", "A", "B", "m0", "1", ts("2024-01-01 00:00:00"))]
    t = tablas(spark, contacto_empresa=ce)
    adf = spark.createDataFrame(
        [(sid, f"E{sid}", "Rif", d, "A", "B", m, "1", ts(f"2024-01-01 00:{sid:02d}:00")) for sid, d, m in altas],
        esq(("solicitud_id", L_), ("empresa_nombre", S), ("emp_tipodoc", S), ("emp_doc", S), ("emp_nombre", S),
            ("emp_apellido", S), ("emp_email", S), ("emp_telefono", S), ("en", T.TimestampType())))
    r = K.alta_contactos(t, adf)
    assert {x.solicitud_id: x.motivo for x in r["resultado"].collect()} == _modelo_contactos(existentes, altas)
    assert r["contacto_empresa"].select("emp_doc").distinct().count() == r["contacto_empresa"].count()


def test_otp_d19(spark):
    tk = [(1, "a@x", "111", ts("2024-01-01 00:15:00"), 0), (2, "a@x", "111", ts("2024-01-01 00:30:00"), 0),
          (3, "b@x", "222", ts("2024-01-01 00:15:00"), 1), (4, "c@x", "333", ts("2024-01-01 00:15:00"), 0),
          (5, "d@x", "444", ts("2024-01-01 00:15:00"), 0)]
    t = tablas(spark, token_otp=tk)
    intentos = spark.createDataFrame([
        (1, "a@x", "111", ts("2024-01-01 00:30:00")),   # newest token (id 2), exactly at expiry: ok
        (2, "a@x", "111", ts("2024-01-01 00:31:00")),   # same token again: used
        (3, "b@x", "222", ts("2024-01-01 00:01:00")),   # used before
        (4, "c@x", "333", ts("2024-01-01 00:15:00.000001")),  # 1 microsecond late
        (5, "d@x", "999", ts("2024-01-01 00:01:00")),   # wrong code
    ], "intento_id long, email string, codigo string, en timestamp")
    ver = O.otp_intentos(t, intentos)
    assert {r.intento_id: r.veredicto for r in ver.collect()} == \
        {1: "ok", 2: "usado", 3: "usado", 4: "expirado", 5: "incorrecto"}
    usados = {r.id_otp: r.usado for r in O.tokens_tras_intentos(t, ver).collect()}
    assert usados == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}
    sol = spark.createDataFrame([(10, "a@x", "777", ts("2024-01-02 00:00:00")), (11, "a@x", "888", ts("2024-01-02 00:01:00")),
                                 (12, "z@x", "999", ts("2024-01-02 00:02:00"))],
                                "solicitud_id long, email string, codigo string, en timestamp")
    nuevos = {(r.id_otp, r.email, r.codigo, str(r.expira_en)) for r in O.emitir_tokens(t, sol).collect()}
    assert nuevos == {(3, "b@x", "222", "2024-01-01 00:15:00"), (4, "c@x", "333", "2024-01-01 00:15:00"),
                      (5, "d@x", "444", "2024-01-01 00:15:00"), (7, "a@x", "888", "2024-01-02 00:16:00"),
                      (8, "z@x", "999", "2024-01-02 00:17:00")}


def test_otp_campos_obligatorios(spark):
    t = tablas(spark, token_otp=[(1, "a@x", "", ts("2024-01-01 00:15:00"), 0), (2, "a@x", "111", ts("2024-01-01 00:15:00"), 0)])
    intentos = spark.createDataFrame([
        (1, "a@x", "", ts("2024-01-01 00:01:00")),      # empty code: refused before any lookup
        (2, "a@x", "111", ts("2024-01-01 00:02:00")),   # first real attempt on token 2: ok
    ], "intento_id long, email string, codigo string, en timestamp")
    assert {r.intento_id: r.veredicto for r in O.otp_intentos(t, intentos).collect()} == {1: "faltan_datos", 2: "ok"}


def test_cadena_de_contactos_sin_tope(spark):
    """A chain of 24 requests, each sharing its document or its e-mail with the next: every second one is new."""
    import datetime as dt

    from matricula.operators import cambios as K

    campos = K.CAMPOS_CONTACTO
    filas = []
    for i in range(24):
        v = {c: "x" for c in campos} | {"emp_doc": f"d{(i + 1) // 2}", "emp_email": f"e{i // 2}"}
        filas.append((i, dt.datetime(2024, 1, 1, 0, i), *[v[c] for c in campos]))
    tipos = "solicitud_id long, en timestamp, " + ", ".join(f"{c} string" for c in campos)
    ce = spark.createDataFrame([], "id_contacto long, " + ", ".join(f"{c} string" for c in campos) + ", creado_en timestamp")
    hechos = []
    DataFrame = type(ce)
    original = DataFrame.checkpoint
    DataFrame.checkpoint = lambda self, eager=True: (hechos.append(1), original(self, eager))[1]
    try:
        res = K.alta_contactos({"contacto_empresa": ce}, spark.createDataFrame(filas, tipos))["resultado"].collect()
    finally:
        DataFrame.checkpoint = original
    docs, correos, quiere = set(), set(), {}
    for i, _, *v in filas:
        f = dict(zip(campos, v, strict=True))
        ok = f["emp_doc"] not in docs and f["emp_email"] not in correos
        quiere[i] = "ok" if ok else "duplicado"
        if ok:
            docs.add(f["emp_doc"])
            correos.add(f["emp_email"])
    assert {r.solicitud_id: r.motivo for r in res} == quiere
    assert len(hechos) <= 14
