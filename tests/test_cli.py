"""Command line entry points."""

import os
import tempfile

from matricula.__main__ import main


def test_lista_de_consultas(capsys):
    assert main(["consultas"]) == 0
    assert "participantes" in capsys.readouterr().out.split()


def test_consulta_a_parquet(spark):
    salida = os.path.join(tempfile.mkdtemp(prefix="cli-", dir=os.environ.get("TMPDIR", "/tmp")), "est")
    assert main(["consulta", "estadisticas", "/root/testdata/sf0.001", "--salida", salida]) == 0
    filas = spark.read.parquet(salida).collect()
    assert len(filas) == 1 and filas[0].totalOfertas > 0


def test_toda_entrada_tiene_esquema():
    from matricula.__main__ import ENTRADAS, TRABAJOS
    from matricula.sources.esquemas import CAMBIOS

    assert set(ENTRADAS) == set(TRABAJOS)
    assert {c for v in ENTRADAS.values() for c in v} - {"veredictos"} <= set(CAMBIOS)
