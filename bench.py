"""Bench: headline queries over the domain tables derived from ``$BENCH_SF_DIR``.

The stand-in domain tables and change sets are derived once and written as Parquet to a
scratch folder (timed separately as ``preparacion_s``), as they would sit at rest in a real
deployment; each query then runs over typed scans of those files and is fully executed with a
``noop`` write. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from matricula.operators import admision as A  # noqa: E402
from matricula.operators import consultas as C  # noqa: E402
from matricula.operators import lotes as L  # noqa: E402
from matricula.operators import otp as O  # noqa: E402
from matricula.plans import trabajos  # noqa: E402
from matricula.sesion import crear_sesion  # noqa: E402
from matricula.sources import almacen, deposito, preparacion  # noqa: E402
from matricula.sources.esquemas import TABLAS  # noqa: E402

CAMBIOS = ["solicitud_registro", "lote_fila", "intento_otp"]

CONSULTAS = {
    "participantes": lambda t: C.participantes(t),
    "lotes_pendientes": lambda t: C.lotes_pendientes(t),
    "ofertas_activas": lambda t: C.ofertas_activas(t),
    "admision_registro": lambda t: A.admision_registro(t, t["solicitud_registro"]),
    "admision_lotes": lambda t: L.admision_lotes(t, t["lote_fila"]),
    "ofertas_todas": lambda t: C.ofertas_todas(t),
    "estadisticas": lambda t: C.estadisticas(t),
    "otp_intentos": lambda t: O.otp_intentos(t, t["intento_otp"]),
}
PRINCIPALES = ["participantes", "lotes_pendientes", "ofertas_activas", "admision_registro", "admision_lotes"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeticiones = int(os.environ.get("BENCH_REPS", "2"))
    spark = crear_sesion(f"local[{cpus}]", particiones=2 * cpus, memoria=os.environ.get("BENCH_MEM", "16g"))
    scratch = tempfile.mkdtemp(prefix="matricula-bench-")

    t0 = time.time()
    base = preparacion.cargar(spark, sf_dir)
    almacen.materializar(base, list(TABLAS) + CAMBIOS, scratch)
    prep = time.time() - t0
    t = almacen.abrir(spark, scratch, list(TABLAS) + CAMBIOS)

    tiempos: dict[str, float] = {}
    filas: dict[str, int] = {}
    for nombre, fn in CONSULTAS.items():
        mejor = None
        for _ in range(repeticiones):
            t1 = time.time()
            df = fn(t)
            df.write.format("noop").mode("overwrite").save()
            dt = time.time() - t1
            mejor = dt if mejor is None else min(mejor, dt)
        tiempos[nombre] = round(mejor, 3)
        filas[nombre] = fn(t).count()

    # Batches over tables at rest: registrations appended, decisions rewriting what they touch.
    raiz = f"{scratch}/deposito"
    deposito.crear(spark, raiz, {n: t[n] for n in TABLAS})
    t1 = time.time()
    trabajos.registro(spark, raiz, t["solicitud_registro"])
    tiempos["confirmar_registro"] = round(time.time() - t1, 3)
    filas["confirmar_registro"] = deposito.leer(spark, raiz, "inscripcion").count()

    total = round(sum(tiempos[k] for k in PRINCIPALES), 3)
    print(json.dumps({
        "metric": "headline_total_wall",
        "value": total,
        "unit": "sec",
        "queries": tiempos,
        "rows": filas,
        "preparacion_s": round(prep, 3),
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
