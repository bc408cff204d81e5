"""W1 / W4 admission against a one-request-at-a-time model, plus semantics-ledger edges."""

import random

from fabrica import inscripcion, oferta, persona, solicitud, tablas

from matricula.operators import admision as A
from matricula.sources.esquemas import CAMBIOS


def modelo(ofertas, inscritos, pedidos):
    """ofertas: {id: (cupos, bloq)}; inscritos: list of (doc, oferta); pedidos sorted by arrival."""
    pares = set(inscritos)
    n = {}
    for d, o in inscritos:
        n[o] = n.get(o, 0) + 1
    out = {}
    for sid, doc, of in pedidos:
        if of not in ofertas:
            out[sid] = "no_existe"
        elif ofertas[of][1] == 1:
            out[sid] = "pausada"
        elif (ofertas[of][0] or 0) - n.get(of, 0) < 1:
            out[sid] = "sin_cupos"
        elif (doc, of) in pares:
            out[sid] = "duplicado"
        else:
            out[sid] = "ok"
            pares.add((doc, of))
            n[of] = n.get(of, 0) + 1
    return out


def test_admision_igual_al_modelo_secuencial(spark):
    for semilla in range(4):
        rnd = random.Random(semilla)
        ofertas = {o: (rnd.choice([0, 1, 2, 3, 5, None]), rnd.choice([0, 0, 0, 1, None])) for o in range(1, 7)}
        inscritos = sorted({(str(100000 + rnd.randint(0, 12)), rnd.randint(1, 6)) for _ in range(8)})
        pedidos = []
        for i in range(120):
            doc = str(100000 + rnd.randint(0, 15))
            of = rnd.choice([1, 1, 1, 2, 3, 4, 5, 6, 9])  # offer 1 is hot, 9 does not exist
            pedidos.append((i, doc, of, f"2024-01-01 00:{rnd.randint(0, 59):02d}:00"))
        t = tablas(
            spark,
            capacitacion_oferta=[oferta(o, c, bloq=b) for o, (c, b) in ofertas.items()],
            inscripcion=[inscripcion(1000 + k, d, o) for k, (d, o) in enumerate(inscritos)],
        )
        sol = spark.createDataFrame([solicitud(i, d, o, en) for i, d, o, en in pedidos], CAMBIOS["solicitud_registro"])
        res = {r.solicitud_id: (r.motivo, r.inscodigo) for r in A.admision_registro(t, sol).collect()}
        orden = sorted(pedidos, key=lambda p: (p[3], p[0]))
        esperado = modelo(ofertas, inscritos, [(i, d, o) for i, d, o, _ in orden])
        assert {k: v[0] for k, v in res.items()} == esperado, semilla
        # New codes continue after the largest one, in arrival order.
        ok = [i for i, _, _, _ in orden if esperado[i] == "ok"]
        base = 1000 + len(inscritos) - 1
        assert [res[i][1] for i in ok] == list(range(base + 1, base + 1 + len(ok)))


def test_orden_de_motivos_d7(spark):
    # Offer 1 full with the person already enrolled: "no seats" wins over "duplicate" (D7).
    # Offer 2 free with the person enrolled: duplicate. Offer 3 blocked, 4 inactive but open.
    t = tablas(
        spark,
        capacitacion_oferta=[oferta(1, 1), oferta(2, 5), oferta(3, 5, bloq=1), oferta(4, 5, estatus=0),
                             oferta(5, None, bloq=None)],
        inscripcion=[inscripcion(1, "1234567", 1, estado="rechazado"), inscripcion(2, "1234567", 2)],
    )
    sol = spark.createDataFrame([
        solicitud(1, "1234567", 1, "2024-01-01 00:00:00"),
        solicitud(2, "1234567", 2, "2024-01-01 00:00:01"),
        solicitud(3, "7654321", 3, "2024-01-01 00:00:02"),
        solicitud(4, "7654321", 4, "2024-01-01 00:00:03"),
        solicitud(5, "7654321", 5, "2024-01-01 00:00:04"),
        solicitud(6, "7654321", 99, "2024-01-01 00:00:05"),
    ], CAMBIOS["solicitud_registro"])
    res = {r.solicitud_id: r.motivo for r in A.admision_registro(t, sol).collect()}
    assert res == {1: "sin_cupos", 2: "duplicado", 3: "pausada", 4: "ok", 5: "sin_cupos", 6: "no_existe"}


def test_validacion_y_normalizacion(spark):
    from matricula.operators import validacion as V

    filas = [
        solicitud(1, "123456", 1, "2024-01-01 00:00:00"),
        solicitud(2, "12345", 1, "2024-01-01 00:00:00"),
        solicitud(3, "1234567890", 1, "2024-01-01 00:00:00"),
        solicitud(4, "123456\n", 1, "2024-01-01 00:00:00"),  # D18: trailing newline is not the end
        solicitud(5, "AB12345", 1, "2024-01-01 00:00:00", tipodoc="Pas"),
        solicitud(6, "123456", 1, "2024-01-01 00:00:00", nombre=""),
        solicitud(7, "123456", 1, "2024-01-01 00:00:00", nombre=" "),  # D16: whitespace passes
        solicitud(8, "123456", 1, "2024-01-01 00:00:00", codpais="58"),
        solicitud(9, "123456", 1, "2024-01-01 00:00:00", telefono="12"),
        solicitud(10, "123456", 1, "2024-01-01 00:00:00", fechanac=None),
        solicitud(11, "123456", 1, "2024-01-01 00:00:00", nombre="aNA maria"),
    ]
    sol = spark.createDataFrame(filas, CAMBIOS["solicitud_registro"])
    mot = {r.solicitud_id: r.motivo for r in V.validar_solicitudes(sol).collect()}
    assert mot == {1: None, 2: "cedula_invalida", 3: "cedula_invalida", 4: "cedula_invalida", 5: None,
                   6: "faltan_datos", 7: None, 8: "codpais_invalido", 9: "telefono_invalido", 10: "faltan_datos",
                   11: None}
    norm = {r.solicitud_id: r for r in V.solicitudes_normalizadas(V.solicitudes_validas(sol)).collect()}
    assert norm[11].nombre == "Ana maria"  # D17: not initcap
    assert norm[11].apellido == "Perez"
    assert norm[1].telefono == "+58 4141234567"


def test_persona_insert_ignore_y_academico(spark):
    t = tablas(spark, capacitacion_oferta=[oferta(1, 10), oferta(2, 10)], persona=[persona("1111111", "Vieja")])
    sol = spark.createDataFrame([
        solicitud(1, "1111111", 1, "2024-01-01 00:00:00", nombre="nueva"),  # existing person kept (D8)
        solicitud(2, "2222222", 1, "2024-01-01 00:00:01", nombre="primera"),
        solicitud(3, "2222222", 2, "2024-01-01 00:00:02", nombre="segunda"),  # first insert wins
    ], CAMBIOS["solicitud_registro"])
    res = A.admision_registro(t, sol)
    per = {r.perdoc: r.pernombre for r in A.persona_tras_registro(t, res, sol).collect()}
    assert per == {"1111111": "Vieja", "2222222": "Primera"}
    aca = sorted((r.pcap_perdoc, r.pcap_oferta) for r in A.academico_tras_registro(t, res).collect())
    assert aca == [("1111111", 1), ("2222222", 1), ("2222222", 2)]
