"""W5 / W6 lot admission against a one-lot-at-a-time model (D8, D10, D11, W5 skip-and-fit)."""

import random

from fabrica import inscripcion, oferta, persona, tablas
from pyspark.sql import types as T

from matricula.operators import lotes as L

ESQ = T.StructType([T.StructField(n, t) for n, t in [
    ("lote_id", T.LongType()), ("fila", T.LongType()), ("empresa_id", T.LongType()), ("oferta", T.LongType()),
    ("tipodoc", T.StringType()), ("doc", T.StringType()), ("nombre", T.StringType()), ("apellido", T.StringType()),
    ("telefono", T.StringType()), ("email", T.StringType()), ("pais", T.StringType()), ("ciudad", T.StringType()),
    ("fechanac", T.StringType())]])


def fila(lote, fila_, of, doc, nombre="E", tipodoc="Ced", empresa=1):
    return (lote, fila_, empresa, of, tipodoc, doc, nombre, "X", "+58 1", f"{doc}@x", "VE", "Val", "1990-01-01")


def modelo(ofertas, inscritos, lotes):
    pares = set(inscritos)
    n = {}
    for _, o in inscritos:
        n[o] = n.get(o, 0) + 1
    out, nuevos = {}, []
    for lote_id, of, docs in lotes:
        ya = len({d for d in docs if (d, of) in pares})
        need = len(docs) - ya
        if need > 0 and of not in ofertas:
            out[lote_id] = "no_existe"
        elif need > 0 and ofertas[of][1] == 1:
            out[lote_id] = "pausada"
        elif need > 0 and (ofertas[of][0] or 0) - n.get(of, 0) < need:
            out[lote_id] = "sin_cupos"
        else:
            out[lote_id] = "ok"
            for d in docs:
                if (d, of) not in pares:
                    pares.add((d, of))
                    n[of] = n.get(of, 0) + 1
                    nuevos.append((d, of, lote_id))
    return out, nuevos


def test_lotes_igual_al_modelo(spark):
    for semilla, tramo in [(0, 50_000), (1, 2), (2, 3), (3, 1), (4, 0), (5, 0)]:
        rnd = random.Random(semilla)
        ofertas = {o: (rnd.choice([3, 5, 8, 12, 20]), rnd.choice([0, 0, 0, 1])) for o in range(1, 5)}
        inscritos = sorted({(f"D{rnd.randint(0, 25)}", rnd.randint(1, 4)) for _ in range(10)})
        lotes, filas = [], []
        for lote_id in range(40):
            of = rnd.choice([1, 1, 1, 2, 3, 4, 7])  # 1 is hot, 7 missing
            docs = [f"D{rnd.randint(0, 25)}" for _ in range(rnd.randint(1, 6))]
            lotes.append((lote_id, of, docs))
            filas += [fila(lote_id, k, of, d) for k, d in enumerate(docs)]
        t = tablas(
            spark,
            capacitacion_oferta=[oferta(o, c, bloq=b) for o, (c, b) in ofertas.items()],
            inscripcion=[inscripcion(100 + k, d, o) for k, (d, o) in enumerate(inscritos)],
        )
        fdf = spark.createDataFrame(filas, ESQ)
        dec = L.admision_lotes(t, fdf, tam_tramo=tramo)
        got = {r.lote_id: r.motivo for r in dec.collect()}
        esperado, nuevos = modelo(ofertas, inscritos, lotes)
        assert got == esperado, (semilla, tramo)
        ins = L.nuevas_inscripciones(t, fdf, dec).collect()
        assert sorted((r.ins_perdoc, r.ins_oferta, r.lote_id) for r in ins) == sorted(nuevos)
        assert sorted(r.inscodigo for r in ins) == list(range(100 + len(inscritos), 100 + len(inscritos) + len(nuevos)))


def test_caso_w5_y_d10(spark):
    # 10 seats, lots of 8, 5 (skipped) and 2 (fits). D10: a lot of nobody new on a blocked offer
    # is accepted; a new document repeated in a lot with 1 seat left is refused.
    t = tablas(
        spark,
        capacitacion_oferta=[oferta(1, 10), oferta(2, 3, bloq=1), oferta(3, 1)],
        inscripcion=[inscripcion(1, "A", 2), inscripcion(2, "B", 2)],
        persona=[persona("A", "Antes", tipo="Pas")],
    )
    filas = [fila(1, k, 1, f"X{k}") for k in range(8)] + [fila(2, k, 1, f"Y{k}") for k in range(5)] \
        + [fila(3, k, 1, f"Z{k}") for k in range(2)] + [fila(4, 0, 2, "A", nombre="Nuevo", tipodoc="Ced"),
                                                       fila(4, 1, 2, "B")] \
        + [fila(5, 0, 3, "N"), fila(5, 1, 3, "N")]
    fdf = spark.createDataFrame(filas, ESQ)
    dec = L.admision_lotes(t, fdf)
    assert {r.lote_id: r.motivo for r in dec.collect()} == {1: "ok", 2: "sin_cupos", 3: "ok", 4: "ok", 5: "sin_cupos"}
    per = {r.perdoc: r for r in L.persona_tras_lotes(t, fdf, dec).collect()}
    assert "Y0" not in per  # a skipped lot leaves no person change
    assert per["A"].pernombre == "Nuevo" and per["A"].pertipodoc == "Pas"  # D8: type kept, rest overwritten
    assert "N" not in per


def test_nested_roundtrip(spark):
    from matricula.sources import lectores

    filas = [fila(1, 5, 1, "A"), fila(1, 2, 1, "B"), fila(2, 9, 1, "C")]
    plano = lectores.lote_explode(lectores.anidar_lotes(spark.createDataFrame(filas, ESQ)))
    assert sorted((r.lote_id, r.posicion, r.doc) for r in plano.collect()) == [(1, 0, "B"), (1, 1, "A"), (2, 0, "C")]


def test_lotes_decididos_sin_escaneo(spark):
    """Lots decided set-based (need <= 0, far above twice the seats, full or missing offers)
    still agree with the sequential model, and so do the enrolments they create."""
    for semilla, tramo in [(10, 50_000), (11, 2), (12, 0)]:
        rnd = random.Random(semilla)
        ofertas = {o: (rnd.choice([0, 1, 2, 4, 9]), rnd.choice([0, 0, 1])) for o in range(1, 6)}
        inscritos = sorted({(f"D{rnd.randint(0, 12)}", rnd.randint(1, 5)) for _ in range(25)})
        lotes, filas = [], []
        for lote_id in range(60):
            of = rnd.choice([1, 1, 2, 3, 4, 5, 8])
            docs = [f"D{rnd.randint(0, 14)}" for _ in range(rnd.choice([1, 1, 2, 3, 12]))]
            lotes.append((lote_id, of, docs))
            filas += [fila(lote_id, k, of, d) for k, d in enumerate(docs)]
        t = tablas(
            spark,
            capacitacion_oferta=[oferta(o, c, bloq=b) for o, (c, b) in ofertas.items()],
            inscripcion=[inscripcion(100 + k, d, o) for k, (d, o) in enumerate(inscritos)],
        )
        fdf = spark.createDataFrame(filas, ESQ)
        dec = L.admision_lotes(t, fdf, tam_tramo=tramo)
        esperado, nuevos = modelo(ofertas, inscritos, lotes)
        assert {r.lote_id: r.motivo for r in dec.collect()} == esperado, semilla
        cuenta = {}
        for _, _, lote_id in nuevos:
            cuenta[lote_id] = cuenta.get(lote_id, 0) + 1
        assert {r.lote_id: r.nuevos for r in dec.collect() if r.nuevos} == cuenta


def test_oferta_caliente_en_pocas_rondas(spark, monkeypatch):
    """200,000 lots for one offer: the rounds follow the logarithm of its seats, and the decisions are those of the sequential scan."""
    from pyspark.sql import functions as F

    cupos, n = 500, 200_000
    lote = F.col("id")
    tam = F.pmod(F.hash(lote), F.lit(12)) + 1
    filas = spark.range(n).select(lote.alias("lote_id"), F.explode(F.sequence(F.lit(1), tam)).alias("fila")).select(
        "lote_id", F.col("fila").cast("long"), F.lit(1).cast("long").alias("empresa_id"), F.lit(1).cast("long").alias("oferta"), F.lit("Ced").alias("tipodoc"),
        F.concat(F.lit("D"), F.pmod(F.hash("lote_id", "fila"), F.lit(30_000))).alias("doc"), *[F.lit("x").alias(c) for c in ("nombre", "apellido", "telefono", "email", "pais", "ciudad", "fechanac")],
    ).checkpoint()
    t = tablas(spark, capacitacion_oferta=[oferta(1, cupos)])
    rondas = []
    una = L._ronda
    monkeypatch.setattr(L, "_ronda", lambda *a: (rondas.append(1), una(*a))[1])
    got = {r.lote_id: (r.motivo, r.nuevos) for r in L.admision_lotes(t, filas, tam_tramo=1000).collect()}
    assert 0 < len(rondas) <= cupos.bit_length() + 2
    docs = {}
    for r in filas.select("lote_id", "fila", "doc").collect():
        docs.setdefault(r.lote_id, []).append(r.doc)
    admitidos, rest = set(), cupos
    for i in range(n):
        nuevos = set(docs[i]) - admitidos
        need = len(docs[i]) - len(set(docs[i]) & admitidos)
        ok = need <= 0 or need <= rest
        if ok:
            admitidos |= nuevos
            rest -= len(nuevos)
        assert got[i] == (("ok", len(nuevos)) if ok else ("sin_cupos", 0)), i


def test_lecturas_de_inscripciones(spark):
    """The tables' enrolments are read twice to decide lots, and twice to admit registrations."""
    from matricula.operators import admision as A
    from matricula.sources import preparacion

    base = preparacion.cargar(spark, "/root/testdata/sf0.001")
    for decidir, cambio in ((lambda t, c: L.decidir_lotes(t, c), "lote_fila"), (lambda t, c: A.admitir(t, c.select(
            "solicitud_id", "doc", "capacitacion", "recibido_en").toDF("solicitud_id", "doc", "oferta", "en")), "solicitud_registro")):
        leidas = spark.sparkContext.accumulator(0)
        ins = base["inscripcion"].checkpoint()
        total = ins.count()

        def contar(lotes, leidas=leidas):
            for b in lotes:
                leidas.add(b.num_rows)
                yield b

        t = preparacion.desde_dataframes(spark, {**{k: base[k] for k in ("capacitacion_oferta", "persona")}, "inscripcion": ins.mapInArrow(contar, ins.schema)})
        decidir(t, base[cambio]).count()
        assert leidas.value <= 2 * total, (cambio, leidas.value / total)
