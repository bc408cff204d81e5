"""F1-F18 scalar rules."""

import datetime as dt

from pyspark.sql import functions as F

from matricula.functions import escalares as E


def _uno(spark, expr, valor, tipo="string"):
    return spark.createDataFrame([(valor,)], f"x {tipo}").select(expr(F.col("x")).alias("r")).first().r


def test_telefono_f5(spark):
    casos = {None: ("+58", ""), "0414": ("+58", "0414"), "+58 414": ("+58", "414"), "+58 414 55": ("+58", "414 55")}
    for tel, (cod, num) in casos.items():
        assert _uno(spark, E.codpais_de, tel) == cod
        assert _uno(spark, E.numero_de, tel) == num


def test_textos(spark):
    assert _uno(spark, E.primera_mayuscula, "aNA maria") == "Ana maria"
    assert _uno(spark, E.sin_ceros_iniciales, "004141234") == "4141234"
    assert _uno(spark, E.recortar, "  a b ") == "a b"
    assert _uno(spark, E.no_negativo, -3, "int") == 0
    assert _uno(spark, E.entero_js, "5abc") == 5
    assert _uno(spark, E.entero_js, " -12") == -12
    assert _uno(spark, E.entero_js, "abc") is None
    assert _uno(spark, E.empresa_o_defecto, "") == "SIN_EMPRESA"
    assert _uno(spark, E.etiqueta_estado, "otro") == "Rechazado"
    assert _uno(spark, E.etiqueta_estado, "en_revision") == "En Revisión"


def test_fechas(spark):
    d = dt.date(2026, 1, 2)
    assert _uno(spark, E.fecha_corta, d, "date") == "02/01/2026"
    assert _uno(spark, E.fecha_local, d, "date") == "2/1/2026"
    assert _uno(spark, E.fecha_iso, d, "date") == "2026-01-02"
    assert _uno(spark, E.fecha_hora, dt.datetime(2026, 1, 2, 0, 5), "timestamp") == "02/01/2026 12:05 AM"
    assert str(_uno(spark, E.expira, dt.datetime(2026, 1, 2, 0, 5), "timestamp")) == "2026-01-02 00:20:00"


def test_etiquetas_cupos_f9(spark):
    df = spark.createDataFrame([(1, 5), (0, 0), (None, -2), (0, 3)], "b int, r int")
    got = [(x.e, x.d) for x in df.select(E.etiqueta_cupos("b", "r").alias("e"), E.oferta_deshabilitada("b", "r").alias("d")).collect()]
    assert got == [("CERRADO", True), ("AGOTADO", True), ("AGOTADO", True), (None, False)]
