"""S4-S7 tables at rest as partitioned Parquet, the jobs over them, and the streaming admission."""

import datetime as dt
import os
import tempfile

import pytest
from fabrica import inscripcion, oferta, tablas
from pyspark.sql import functions as F

from matricula.operators import admision as A
from matricula.plans import trabajos as J
from matricula.sources import deposito as D
from matricula.sources import lectores, preparacion
from matricula.sources.esquemas import CAMBIOS, TABLAS
from matricula.streaming import registro_continuo as R

SF = "/root/testdata/sf0.001"
HORA = "2024-02-01 00:00:00"


def _carpeta(prefijo):
    return tempfile.mkdtemp(prefix=prefijo, dir=os.environ.get("TMPDIR", "/tmp"))


def _raiz(spark, prefijo, t=None, n=4):
    raiz = _carpeta(prefijo)
    t = t or preparacion.cargar(spark, SF)
    D.crear(spark, raiz, {x: t[x] for x in TABLAS}, n)
    return raiz, t


def _archivos(carpeta):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(carpeta) for f in fs if f.startswith("part-")}


def _filas(df):
    return sorted(map(tuple, df.collect()), key=str)


def _todo(spark, raiz):
    return {n: _filas(D.leer(spark, raiz, n)) for n in TABLAS}


def test_crear_y_abrir(spark):
    raiz, t = _raiz(spark, "crear-")
    for n in TABLAS:
        assert _filas(D.leer(spark, raiz, n)) == _filas(lectores.conformar(t[n], TABLAS[n])), n
    assert D.leer_registro(spark, raiz, "auditoria").count() == D.leer_registro(spark, raiz, "outbox").count() == 0
    vacia = _carpeta("vacia-")
    D.crear(spark, vacia, {})
    assert all(D.leer(spark, vacia, n).count() == 0 for n in TABLAS)
    assert D.cubetas(spark, vacia) == D.CUBETAS


def test_nombres_de_lote(spark):
    raiz, t = _raiz(spark, "nombre-", tablas(spark))
    for malo in (D.BASE, "a/b", "", "x=1"):
        with pytest.raises(ValueError):
            D.agregar(spark, raiz, malo, "persona", t["persona"])


def test_un_alta_solo_agrega_archivos(spark):
    raiz, t = _raiz(spark, "alta-")
    antes = _archivos(raiz)
    una = A.admision_registro(t, t["solicitud_registro"]).where("motivo = 'ok'").orderBy("solicitud_id").first().solicitud_id
    J.registro(spark, raiz, t["solicitud_registro"].where(F.col("solicitud_id") == una), lote="uno")
    despues = _archivos(raiz)
    assert antes.items() <= despues.items()
    assert {f.split("/lote=")[1].split("/")[0] for f in despues.keys() - antes.keys()} == {"uno"}
    assert D.leer(spark, raiz, "inscripcion").count() == t["inscripcion"].count() + 1


def test_repetir_un_lote_no_cambia_nada(spark):
    raiz, t = _raiz(spark, "repetir-")
    J.registro(spark, raiz, t["solicitud_registro"], lote="uno")
    J.registro(spark, raiz, t["solicitud_registro"].where("solicitud_id % 2 = 0").withColumn("doc", F.lit("7654321")), lote="dos")
    antes = _todo(spark, raiz)
    J.registro(spark, raiz, t["solicitud_registro"], lote="uno")  # after another batch, too
    assert _todo(spark, raiz) == antes
    assert D.leer_registro(spark, raiz, "resultados/registro").where("lote = 'uno'").count() == t["solicitud_registro"].count()


def test_una_decision_reescribe_lo_que_toca(spark):
    raiz, t = _raiz(spark, "decidir-", n=16)
    codigo = t["inscripcion"].where("ins_estado = 'en_revision'").orderBy("inscodigo").first().inscodigo
    antes = _archivos(raiz)
    J.decisiones(spark, raiz, spark.createDataFrame([(codigo, "rechazar")], "inscodigo long, decision string"), lote="uno")
    despues = _archivos(raiz)
    cambiados = {f for f in antes if despues.get(f) != antes[f]}
    assert {f[len(raiz) + 1 :].split("/")[0] for f in cambiados} == {"inscripcion", "pago_reportado"}
    assert len({os.path.dirname(f) for f in cambiados}) == 2  # one partition of each of the two tables
    ins = D.leer(spark, raiz, "inscripcion")
    assert ins.where(F.col("inscodigo") == codigo).first().ins_estado == "pendiente" and ins.count() == t["inscripcion"].count()
    assert _filas(ins.where(F.col("inscodigo") != codigo)) == _filas(lectores.conformar(t["inscripcion"], TABLAS["inscripcion"]).where(F.col("inscodigo") != codigo))
    assert D.leer(spark, raiz, "pago_reportado").where(F.col("pago_inscodigo") == codigo).count() == 0


def test_borrar_toda_una_particion(spark):
    t = tablas(spark, capacitacion_oferta=[oferta(1, 5)], inscripcion=[inscripcion(i, f"D{i}", 1) for i in range(1, 9)])
    raiz, _ = _raiz(spark, "vaciar-", t, n=2)
    todos = t["inscripcion"].select("inscodigo")
    J.eliminaciones(spark, raiz, todos, HORA, lote="uno")
    assert D.leer(spark, raiz, "inscripcion").count() == 0
    assert D.leer_registro(spark, raiz, "auditoria").where("lote = 'uno'").count() == 8
    J.eliminaciones(spark, raiz, todos, HORA, lote="uno")  # the decisions of the first run hold
    assert {r.motivo for r in D.leer_registro(spark, raiz, "resultados/eliminaciones").collect()} == {"ok"}
    copia = _carpeta("copia-")
    D.compactar(spark, raiz, copia)
    assert not any("inscripcion/" in f and "_registro" not in f for f in _archivos(copia)) and D.leer(spark, copia, "capacitacion_oferta").count() == 1
    assert D.leer_registro(spark, copia, "auditoria").count() == 8


class Corte(Exception):
    pass


@pytest.mark.parametrize("trabajo", ["registro", "decisiones_lote", "eliminaciones", "ofertas", "lotes"])
def test_un_lote_cortado_se_completa(spark, monkeypatch, trabajo):
    """A batch that fails half way, and is run again, leaves what an undisturbed one leaves."""
    t = preparacion.cargar(spark, SF)
    sesion = t["contacto_empresa"].select(F.col("emp_email").alias("email"), F.lit(HORA).cast("timestamp").alias("en"), F.lit("ok").alias("veredicto"))
    en = F.lit(HORA).cast("timestamp")
    argumentos = {
        "registro": [t["solicitud_registro"]], "decisiones_lote": [t["decision_lote_mixta"], HORA], "eliminaciones": [t["eliminacion"], HORA],
        "ofertas": [t["oferta_borrador"], t["oferta_edicion"], t["toggle_oferta"], HORA], "lotes": [t["lote_fila"].withColumn("en", en), HORA, sesion],
    }[trabajo]
    hacer, escribir, vistas = getattr(J, trabajo), D._escribir, []

    def cortar(*a, hasta=None):
        if hasta is not None and len(vistas) >= hasta:
            raise Corte
        vistas.append(1)
        escribir(*a)

    limpio, _ = _raiz(spark, "limpio-", t)
    monkeypatch.setattr(D, "_escribir", cortar)
    hacer(spark, limpio, *argumentos, lote="uno")
    monkeypatch.undo()
    total, raiz = len(vistas), _raiz(spark, "cortado-", t)[0]
    assert total >= 2
    vistas.clear()
    monkeypatch.setattr(D, "_escribir", lambda *a: cortar(*a, hasta=total - 1))  # all but the last write of the batch
    with pytest.raises(Corte):
        hacer(spark, raiz, *argumentos, lote="uno")
    monkeypatch.undo()
    hacer(spark, raiz, *argumentos, lote="uno")
    assert _todo(spark, raiz) == _todo(spark, limpio)
    resultados = [_filas(D.leer_registro(spark, r, f"resultados/{trabajo}").where("lote = 'uno'")) for r in (limpio, raiz)]
    assert resultados[0] == resultados[1] != []


def test_trabajos_encadenados(spark):
    """Registration, payments, decisions and deletions applied as batches."""
    raiz, t = _raiz(spark, "trabajos-")
    n0 = t["inscripcion"].count()
    J.registro(spark, raiz, t["solicitud_registro"])
    ok = D.leer_registro(spark, raiz, "resultados/registro").where("motivo = 'ok'").count()
    assert D.leer(spark, raiz, "inscripcion").count() == n0 + ok
    assert D.leer_registro(spark, raiz, "auditoria").count() == ok
    J.pagos(spark, raiz, t["pago_solicitud"], HORA)
    revision = D.leer(spark, raiz, "inscripcion").where("ins_estado = 'en_revision'").select("inscodigo")
    decision = revision.withColumn("decision", F.when(F.col("inscodigo") % 2 == 1, "aprobar").otherwise("rechazar")).checkpoint()
    J.decisiones(spark, raiz, decision)
    t4 = D.abrir(spark, raiz)
    assert t4["inscripcion"].where("ins_estado = 'en_revision'").count() == 0
    huerfanos = t4["pago_reportado"].join(
        decision.where("decision = 'rechazar'").withColumnRenamed("inscodigo", "pago_inscodigo"), "pago_inscodigo", "left_semi")
    assert huerfanos.count() == 0
    plantillas = {r.plantilla for r in D.leer_registro(spark, raiz, "outbox").select("plantilla").distinct().collect()}
    assert plantillas == {"pago_reportado", "pago_aprobado", "pago_rechazado"}
    J.eliminaciones(spark, raiz, t4["inscripcion"].where("inscodigo % 20 = 0").select("inscodigo").checkpoint(), "2024-02-02 00:00:00")
    t5 = D.abrir(spark, raiz)
    assert t5["inscripcion"].where("inscodigo % 20 = 0").count() == 0
    # Invariants: every payment's enrolment exists; (doc, offer) stays unique.
    assert t5["pago_reportado"].join(t5["inscripcion"].withColumnRenamed("inscodigo", "pago_inscodigo"),
                                     "pago_inscodigo", "left_anti").count() == 0
    assert t5["inscripcion"].groupBy("ins_perdoc", "ins_oferta").count().where("count > 1").count() == 0


def test_trabajos_lotes_ofertas_codigos(spark):
    raiz, t = _raiz(spark, "trabajos2-")
    # Only company 0 has an accepted code: the other companies' lots are refused before admission.
    ver = spark.createDataFrame([("e0@example.org", dt.datetime(2024, 1, 31, 23), "ok")], "email string, en timestamp, veredicto string")
    en = F.lit(HORA).cast("timestamp")
    J.lotes(spark, raiz, lectores.lote_explode(lectores.anidar_lotes(t["lote_fila"]).withColumn("en", en)), HORA, ver)
    res = D.leer_registro(spark, raiz, "resultados/lotes")
    assert {r.empresa_id for r in res.where("motivo = 'sin_codigo'").collect()} == {1, 2}
    assert res.where("motivo = 'sin_codigo' AND empresa_id = 0").count() == 0
    assert res.count() == t["lote_fila"].select("lote_id").distinct().count()
    J.pagos_lote(spark, raiz, t["pago_lote_solicitud"].withColumn("en", en), HORA, ver)
    J.decisiones_lote(spark, raiz, t["decision_lote"], "2024-02-02 00:00:00")
    J.ofertas(spark, raiz, t["oferta_borrador"], t["oferta_edicion"], t["toggle_oferta"], "2024-02-02 00:00:00")
    J.perfiles(spark, raiz, t["persona_edicion"])
    J.contactos(spark, raiz, t["contacto_alta"])
    J.codigos(spark, raiz, t["solicitud_otp"], t["solicitud_otp_empresa"])
    J.intentos(spark, raiz, t["intento_otp_empresa"])
    fin = D.abrir(spark, raiz)
    assert fin["capacitacion_oferta"].count() > t["capacitacion_oferta"].count()
    assert fin["contacto_empresa"].count() >= t["contacto_empresa"].count()
    assert fin["persona"].where("pernombre = 'Editado'").count() > 0
    # One token per e-mail that asked for a code; accepted attempts marked used.
    tk = fin["token_otp"]
    assert tk.groupBy("email").count().where("count > 1").join(
        t["solicitud_otp"].select("email").distinct(), "email", "left_semi").count() == 0
    plantillas = {r.plantilla for r in D.leer_registro(spark, raiz, "outbox").select("plantilla").distinct().collect()}
    assert {"otp", "pago_lote_reportado", "lote_empleado_aprobado"} <= plantillas
    # The checked attempts are the sessions of later batches.
    aceptados = D.leer_registro(spark, raiz, "resultados/intentos").where("veredicto = 'ok'")
    uno = aceptados.orderBy("intento_id").first()
    quien = fin["contacto_empresa"].where(F.col("emp_email") == uno.email).first().id_contacto
    sol = t["pago_lote_solicitud"].limit(1).withColumn("empresa_id", F.lit(quien))
    for horas, motivo in ((1, None), (2, "sesion_expirada")):
        lote = J.pagos_lote(spark, raiz, sol.withColumn("en", F.lit(uno.en + dt.timedelta(hours=horas))), HORA)
        r = D.leer_registro(spark, raiz, "resultados/pagos_lote").where(F.col("lote") == lote).first()
        assert (r.motivo == motivo) if motivo else r.motivo in ("ok", "sin_pendientes")


def test_ofertas_dejan_resultados_y_auditoria(spark):
    raiz, t = _raiz(spark, "ofertas-")
    toggles = t["toggle_oferta"]
    J.ofertas(spark, raiz, None, t["oferta_edicion"], toggles, "2024-02-02 00:00:00")
    res = D.leer_registro(spark, raiz, "resultados/ofertas")
    assert res.count() == t["oferta_edicion"].count() + toggles.count()
    audit = D.leer_registro(spark, raiz, "auditoria")
    assert audit.count() == res.where("motivo = 'ok'").count() > 0
    assert {r.accion for r in audit.select("accion").distinct().collect()} <= {"OFERTA_EDITADA", "ESTATUS_MODIFICADO", "BLOQUEO_MODIFICADO"}


def test_pagos_de_lote_sin_sesion_se_rechazan(spark):
    raiz, t = _raiz(spark, "sesion-")
    J.pagos_lote(spark, raiz, t["pago_lote_solicitud"], HORA)  # no time of arrival, no attempt checked
    res = D.leer_registro(spark, raiz, "resultados/pagos_lote")
    assert {r.motivo for r in res.select("motivo").distinct().collect()} == {"sin_fecha"}
    assert res.count() == t["pago_lote_solicitud"].count()
    assert D.leer(spark, raiz, "pago_reportado").count() == t["pago_reportado"].count()


# ---------------------------------------------------------------- stream and JSON


def test_flujo_igual_al_lote(spark):
    raiz, t = _raiz(spark, "flujo-")
    sol = t["solicitud_registro"].withColumns({c: F.col(c).cast("string") for c in ("solicitud_id", "capacitacion")})
    # Requests arrive as three files in time order, with text ids and a broken line in each.
    cortes = ["2024-01-11", "2024-01-21"]
    partes = [sol.where(F.col("recibido_en") < cortes[0]),
              sol.where((F.col("recibido_en") >= cortes[0]) & (F.col("recibido_en") < cortes[1])),
              sol.where(F.col("recibido_en") >= cortes[1])]
    plano = f"{raiz}/_plano"
    os.makedirs(plano)
    for i, p in enumerate(partes):
        formato = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
        lineas = [r.v for r in p.select(F.to_json(F.struct(*p.columns), formato).alias("v")).collect()]
        with open(f"{plano}/{i}.json", "w") as f:
            f.write("\n".join([*lineas, f'{{"solicitud_id": "{i}', '{"solicitud_id": "x", "doc": "1"}']))
        os.utime(f"{plano}/{i}.json", (1_000_000 + i, 1_000_000 + i))
    R.iniciar(spark, plano, raiz, f"{raiz}/_ckpt", archivos_por_lote=1).awaitTermination(300)
    flujo = {r.solicitud_id: (r.motivo, r.inscodigo) for r in D.leer_registro(spark, raiz, "resultados/registro").where("solicitud_id IS NOT NULL").collect()}
    lote = {r.solicitud_id: (r.motivo, r.inscodigo) for r in A.admision_registro(t, t["solicitud_registro"]).collect()}
    assert flujo == lote
    malas = D.leer_registro(spark, raiz, R.MALAS)
    assert sorted(r.motivo for r in malas.collect()) == ["no_es_registro"] * 3 + ["valor_ilegible"] * 3
    assert malas.select("lote").distinct().count() == 3
    fin = D.leer(spark, raiz, "inscripcion")
    assert fin.count() == t["inscripcion"].count() + sum(1 for m, _ in lote.values() if m == "ok")


def test_epoca_repetida_no_cambia_nada(spark):
    """A micro-batch replayed after a failure (same epoch) leaves the tables as they are, also after other jobs."""
    raiz, t = _raiz(spark, "replay-")
    lote = t["solicitud_registro"].withColumn("linea_mala", F.lit(None).cast("string"))
    R.procesar_lote(spark, raiz, lote, 0)
    J.perfiles(spark, raiz, t["persona_edicion"])
    antes = _todo(spark, raiz)
    R.procesar_lote(spark, raiz, lote, 0)
    assert _todo(spark, raiz) == antes
    R.procesar_lote(spark, raiz, lote, 1)  # another epoch finds the seats taken
    assert D.leer(spark, raiz, "inscripcion").count() == len(antes["inscripcion"])


def test_json_con_ids_de_texto_y_lineas_malas(spark):
    carpeta = tempfile.mkdtemp(prefix="json-", dir=os.environ.get("TMPDIR", "/tmp"))
    lineas = [
        '{"solicitud_id": "7", "doc": "1", "capacitacion": " 60 ", "recibido_en": "2024-01-02T03:04:05"}',
        '{"solicitud_id": 8, "doc": "2", "capacitacion": "x", "recibido_en": "no"}',
        '{"solicitud_id": 9, "doc"',
        "otra cosa",
    ]
    with open(f"{carpeta}/a.json", "w") as f:
        f.write("\n".join(lineas))
    filas = {r.solicitud_id: r for r in lectores.leer_solicitudes(spark, carpeta).collect()}
    assert set(filas) == {7, 8} and filas[7].capacitacion == 60 and filas[8].capacitacion is None
    assert str(filas[7].recibido_en) == "2024-01-02 03:04:05" and filas[8].recibido_en is None
    malas = sorted((r.motivo, r.linea) for r in lectores.lineas_malas(spark, carpeta, "solicitud_registro").collect())
    assert [m for m, _ in malas] == ["no_es_registro", "no_es_registro", "valor_ilegible"]
    assert malas[1][1] == "otra cosa" or malas[0][1] == "otra cosa"


def test_sin_fecha_de_llegada_no_toma_cupo(spark):
    t = preparacion.cargar(spark, SF)
    sol = t["solicitud_registro"].withColumn(
        "recibido_en", F.when(F.col("solicitud_id") % 5 == 0, None).otherwise(F.col("recibido_en")))
    res = A.admision_registro(t, sol).checkpoint(eager=True)
    assert res.where("solicitud_id % 5 = 0 and motivo = 'ok'").count() == 0
    assert res.where("motivo = 'sin_fecha'").count() > 0
    ok = A.admision_registro(t, sol.where("solicitud_id % 5 <> 0")).where("motivo = 'ok'").count()
    assert res.where("motivo = 'ok'").count() == ok
    nuevas = A.personas_nuevas(t, res, sol).count()
    con_persona = res.where("motivo in ('ok', 'duplicado')").select("doc").distinct().join(
        t["persona"].select(F.col("perdoc").alias("doc")), "doc", "left_anti").count()
    assert nuevas == con_persona


def test_decisiones_en_orden_de_llegada(spark):
    import datetime as dt

    from matricula.operators import cambios as K

    t = preparacion.cargar(spark, SF)
    uno, dos = (r.pago_inscodigo for r in t["pago_reportado"].join(
        t["inscripcion"].select("inscodigo"), F.col("pago_inscodigo") == F.col("inscodigo")).orderBy("pago_inscodigo").select("pago_inscodigo").distinct().orderBy("pago_inscodigo").limit(2).collect())
    h = [dt.datetime(2024, 1, 1, i) for i in range(3)]
    filas = [(uno, "aprobar", h[0], 1), (uno, "rechazar", h[1], 2), (dos, "rechazar", h[0], 3), (dos, "aprobar", h[2], 4)]
    r = K.decidir_pagos(t, spark.createDataFrame(filas, "inscodigo long, decision string, en timestamp, solicitud_id long"))
    estado = {x.inscodigo: x.ins_estado for x in r["inscripcion"].where(F.col("inscodigo").isin(uno, dos)).collect()}
    assert estado == {uno: "pendiente", dos: "conciliado"}
    assert r["pago_reportado"].where(F.col("pago_inscodigo").isin(uno, dos)).count() == 0



def test_lotes_json_y_cuarentena(spark):
    carpeta = _carpeta("lotes-")
    ana = '{"fila": 1, "doc": " 12 ", "nombre": "Ana", "apellido": "", "email": "a@x", "fechanac": "1990-01-01", "telefono": "+58 1", "tipodoc": "Ced"}'
    lineas = [
        f'{{"lote_id": "1", "empresa_id": "7", "oferta": 8, "en": "2024-01-01T00:00:00", "empleados": [{ana}, {ana}]}}',
        f'{{"lote_id": 2, "empresa_id": 7, "oferta": 8, "empleados": [{ana}, {{"doc": "  "}}]}}',
        '{"lote_id": 3, "empresa_id": 7, "oferta": 8, "empleados": []}', '{"lote_id": 4, "empresa_id": 7, "oferta": 8}',
        f'{{"lote_id": 5, "empresa_id": "no", "oferta": 8, "empleados": [{ana}]}}', "rota",
    ]
    with open(f"{carpeta}/a.json", "w") as f:
        f.write("\n".join(lineas))
    buenas, malas = lectores.revisar_lotes(lectores.leer_lotes(spark, carpeta))
    assert [(r.lote_id, r.empresa_id, r.posicion, r.doc, str(r.en)) for r in buenas.orderBy("posicion").collect()] == [
        (1, 7, 0, "12", "2024-01-01 00:00:00"), (1, 7, 1, "12", "2024-01-01 00:00:00")]
    assert sorted((r.lote_id, r.posicion, r.motivo) for r in malas.collect()) == [
        (2, 1, "empleado_incompleto"), (3, None, "sin_empleados"), (4, None, "sin_empleados"), (5, None, "id_ilegible")]
    assert lectores.lineas_malas(spark, carpeta, "lote").count() == 2  # the broken line, and the unreadable company


def test_vida_de_la_sesion(spark):
    from matricula.operators import otp as O

    t0 = dt.datetime(2024, 1, 1, 10, 30)
    h = lambda x: t0 + dt.timedelta(hours=x)
    ver = [("a@x", t0, "ok"), ("a@x", h(-5), "ok"), ("a@x", h(9), "usado"), ("b@x", t0, "incorrecto"), ("c@x", t0, "ok"), ("a@x", h(20), "ok"), ("a@x", h(20.5), "ok")]
    ce = [(i, "E", "Rif", str(i), "N", "A", m, "t", t0) for i, m in ((1, "a@x"), (2, "b@x"), (3, "c@x"))]
    casos = [
        (1, None, h(0), None), (1, None, h(1.999), None), (1, None, h(2), "sesion_expirada"), (1, None, h(-0.001), "sesion_expirada"), (1, None, h(-6), "sin_codigo"),
        (1, None, h(10), "sesion_expirada"), (1, None, h(22.4), None), (1, None, h(22.5), "sesion_expirada"), (2, None, h(1), "sin_codigo"),
        (3, "a@x", h(1), "codigo_ajeno"), (3, "c@x", h(1), None), (9, "a@x", h(1), "sin_contacto"), (9, None, h(1), "sin_contacto"), (1, None, None, "sin_fecha"),
        (1, "", h(1), "sin_codigo"),
    ]
    envios = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(casos)], "n long, empresa_id long, sesion_email string, en timestamp")
    r = O.autorizar(tablas(spark, contacto_empresa=ce), envios, spark.createDataFrame(ver, "email string, en timestamp, veredicto string"))
    assert {x.n: x.motivo for x in r.collect()} == {i: c[3] for i, c in enumerate(casos)}
    assert set(CAMBIOS["lote"].names) >= {"sesion_email", "en"}
