import random

import pandas as pd
from pyspark.sql import types as T

from matricula.operators.secuencia import numerar, suma_acumulada


def test_suma_acumulada_con_clave_caliente(spark):
    rnd = random.Random(7)
    filas = []
    for i in range(3000):
        k = 0 if rnd.random() < 0.4 else rnd.randint(1, 30)  # one key holds ~40% of the rows
        filas.append((k, rnd.randint(0, 50), i, rnd.randint(0, 1)))
    esquema = T.StructType([T.StructField(n, T.LongType()) for n in ["k", "t", "id", "v"]])
    df = spark.createDataFrame(filas, esquema)
    for bloques in (1, 3, 16):
        got = suma_acumulada(df, ["k"], ["t", "id"], "v", "acum", bloques=bloques).toPandas()
        pdf = pd.DataFrame(filas, columns=["k", "t", "id", "v"]).sort_values(["k", "t", "id"])
        pdf["acum"] = pdf.groupby("k")["v"].cumsum()
        m = got.merge(pdf, on="id", suffixes=("", "_e"))
        assert len(m) == len(filas)
        assert (m["acum"] == m["acum_e"]).all(), bloques


def test_numerar_global(spark):
    esquema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.LongType())])
    filas = [(i, (i * 37) % 101) for i in range(500)]
    got = numerar(spark.createDataFrame(filas, esquema), ["t", "id"], "rn", bloques=7).toPandas()
    esperado = {r[0]: n + 1 for n, r in enumerate(sorted(filas, key=lambda r: (r[1], r[0])))}
    assert dict(zip(got["id"], got["rn"])) == esperado


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    filas=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.integers(0, 1)), min_size=1, max_size=80),
    bloques=st.integers(1, 9),
)
def test_suma_acumulada_propiedad(spark, filas, bloques):
    datos = [(k, t, i, v) for i, (k, t, v) in enumerate(filas)]
    esquema = T.StructType([T.StructField(n, T.LongType()) for n in ["k", "t", "id", "v"]])
    got = suma_acumulada(spark.createDataFrame(datos, esquema), ["k"], ["t", "id"], "v", "acum", bloques=bloques)
    got = {r.id: r.acum for r in got.collect()}
    esperado, acum = {}, {}
    for k, t, i, v in sorted(datos, key=lambda r: (r[0], r[1], r[2])):
        acum[k] = acum.get(k, 0) + v
        esperado[i] = acum[k]
    assert got == esperado
