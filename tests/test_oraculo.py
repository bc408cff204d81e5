"""Every registered query against its DuckDB oracle (the driver's check), at sf0.001."""

import pytest

import __spark_entry__ as E
from oraculo import comparar, duck

SF = "/root/testdata/sf0.001"
#: The optional training-data queries are tested in tests/llm.
CLAVES = sorted(E.catalogo.ORACULO)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("clave", CLAVES)
def test_consulta_igual_al_oraculo(spark, con, clave):
    ok, info = comparar(spark, con, E.queries()[clave], E.oracle_sql()[clave], SF)
    assert ok, info


def test_toda_consulta_tiene_oraculo():
    assert set(E.catalogo.REGISTRO) == set(E.catalogo.ORACULO)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["inscodigo", "ins_estado", "fecha_formateada"]


def _orden(df, *claves):
    filas = [tuple(r[c] for c, _ in claves) for r in df.collect()]
    esperado = list(filas)
    for i, (_, sentido) in reversed(list(enumerate(claves))):
        esperado.sort(key=lambda f: (f[i] is not None, f[i]), reverse=sentido == "desc")
    return len(filas) > 1 and filas == esperado


def test_orden_de_las_listas(spark):
    """The lists come in the application's order, with the key as tie-break."""
    from matricula.operators import consultas as C
    from matricula.sources import preparacion

    t = preparacion.cargar(spark, SF)
    assert _orden(C.ofertas_todas(t), ("capofcodigo", "desc"))
    grid = C.participantes(t).join(t["inscripcion"].select("inscodigo", "ins_fecha"), "inscodigo")
    fechas = {r.inscodigo: r.ins_fecha for r in grid.select("inscodigo", "ins_fecha").collect()}
    filas = [(fechas[r.inscodigo], r.inscodigo) for r in C.participantes(t).collect()]
    assert len(filas) > 1 and filas == sorted(filas, reverse=True)
    assert _orden(C.contactos_empresa(t), ("creado_en", "desc"), ("id_contacto", "desc"))
    assert _orden(C.capacitaciones_base(t), ("capnombre", "asc"))
