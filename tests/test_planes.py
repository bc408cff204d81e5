"""Plan shape: filters reach the scan, and no window sends a whole offer to one task."""

import os
import tempfile

from matricula.operators import admision as A
from matricula.operators import consultas as C
from matricula.sources import almacen, preparacion
from matricula.sources.esquemas import TABLAS

SF = "/root/testdata/sf0.001"


def test_filtro_de_estado_llega_al_scan(spark):
    dest = tempfile.mkdtemp(prefix="planes-", dir=os.environ.get("TMPDIR", "/tmp"))
    almacen.materializar(preparacion.cargar(spark, SF), list(TABLAS), dest)
    t = almacen.abrir(spark, dest)
    df = C.participantes_filtrados(C.participantes(t), estado="pendiente")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ins_estado,pendiente)" in plan
    # Only the used columns of the person table are read (type and birth date are not shown).
    assert "ReadSchema: struct<perdoc:string" in plan
    assert "pertipodoc" not in plan and "perfechanac" not in plan


def test_admision_sin_ventana_por_oferta(spark):
    t = preparacion.cargar(spark, SF)
    sol = t["solicitud_registro"]
    res = A.admision_registro(t, sol)
    plan = res._jdf.queryExecution().optimizedPlan().toString()
    # Every window is partitioned by the block column too, never by the offer alone.
    for linea in plan.splitlines():
        if "windowspecdefinition(" in linea and "oferta" in linea:
            assert "__blq" in linea, linea


def test_grilla_a_escala_emulada(spark):
    """With the broadcast threshold below the big tables' size, people and payments are joined by
    sort-merge; small dimensions stay broadcast; the ordering is one range-partitioned sort."""
    dest = tempfile.mkdtemp(prefix="planes2-", dir=os.environ.get("TMPDIR", "/tmp"))
    almacen.materializar(preparacion.cargar(spark, SF), list(TABLAS), dest)
    t = almacen.abrir(spark, dest)
    claves = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    antes = {k: spark.conf.get(k, None) for k in claves}
    try:
        for k in claves:
            spark.conf.set(k, str(8 * 1024))
        df = C.participantes(t)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in antes.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert "SortMergeJoin [inscodigo" in plan or "SortMergeJoin [ins_perdoc" in plan
    assert "BroadcastHashJoin" in plan  # the course catalogue is tiny
    assert plan.count("rangepartitioning(") == 1


def test_grilla_en_cubos(spark):
    """Over bucketed tables neither people nor payment reports are shuffled: of the large joins only the enrolments are, once."""
    import re

    dest = tempfile.mkdtemp(prefix="cubos-", dir=os.environ.get("TMPDIR", "/tmp"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = almacen.en_cubos(spark, preparacion.cargar(spark, SF), dest, n)
    claves = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    antes = {k: spark.conf.get(k, None) for k in claves}
    try:
        for k in claves:
            spark.conf.set(k, str(4 * 1024))
        df = C.participantes_base(t)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for k, v in antes.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    cambios = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert "perdoc" not in cambios and "ins_perdoc" not in cambios and "pago_inscodigo" not in cambios
    assert cambios.count("inscodigo") == 1 and plan.count("Bucketed: true") == 3
