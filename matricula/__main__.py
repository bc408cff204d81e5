"""Command line (also usable with ``spark-submit``).

``python -m matricula consultas``
    list the registered queries.
``python -m matricula consulta <key> <sf_dir> [--salida <dir>] [--mostrar N]``
    run one registered query over the tables in ``sf_dir``; write Parquet or print rows.
``python -m matricula trabajo <job> <root> <input> [<input2> ...] [--lote NAME] [--ahora "YYYY-MM-DD HH:MM:SS"] [--formato json]``
    apply one change set (Parquet folder, or JSON lines read with the change set's schema; lots and
    lot payments take the code checks as a second input) to the tables under ``root``; run again under the same ``--lote``, it
    completes a batch that failed half way. Jobs are the functions of ``matricula.plans.trabajos``.
``python -m matricula inicializar <root> <sf_dir>``
    write the stand-in domain tables of ``sf_dir`` under ``root``.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import plans
from .plans import trabajos
from .sesion import aplicar_ajustes
from .sources import deposito, lectores, preparacion
from .sources.esquemas import TABLAS

TRABAJOS = {
    "registro": trabajos.registro, "lotes": trabajos.lotes, "pagos": trabajos.pagos,
    "pagos_lote": trabajos.pagos_lote, "decisiones": trabajos.decisiones,
    "decisiones_lote": trabajos.decisiones_lote, "eliminaciones": trabajos.eliminaciones,
    "ofertas": trabajos.ofertas, "perfiles": trabajos.perfiles, "contactos": trabajos.contactos,
    "codigos": trabajos.codigos, "intentos": trabajos.intentos,
}
CON_HORA = {"lotes", "pagos", "pagos_lote", "decisiones_lote", "eliminaciones", "ofertas"}


# Change sets of each job's inputs, in order.
ENTRADAS = {
    "registro": ["solicitud_registro"], "lotes": ["lote", "veredictos"], "pagos": ["pago_solicitud"],
    "pagos_lote": ["pago_lote_solicitud", "veredictos"], "decisiones": ["decision_pago"], "decisiones_lote": ["decision_lote"],
    "eliminaciones": ["eliminacion"], "ofertas": ["oferta_borrador", "oferta_edicion", "toggle_oferta"],
    "perfiles": ["persona_edicion"], "contactos": ["contacto_alta"], "codigos": ["solicitud_otp", "solicitud_otp_empresa"],
    "intentos": ["intento_otp"],
}


def _leer(spark: SparkSession, ruta: str, formato: str, cambio: str):
    """One input: Parquet, or JSON lines with the explicit schema of its change set."""
    if formato == "parquet":
        return spark.read.parquet(ruta)
    if cambio == "veredictos":
        return spark.read.schema("email string, en timestamp, veredicto string").json(ruta)
    df = lectores.leer_cambio(spark, ruta, cambio)
    return lectores.lote_explode(df) if cambio == "lote" else df


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="matricula")
    sub = ap.add_subparsers(dest="orden", required=True)
    sub.add_parser("consultas")
    c = sub.add_parser("consulta")
    c.add_argument("clave")
    c.add_argument("sf_dir")
    c.add_argument("--salida")
    c.add_argument("--mostrar", type=int, default=20)
    j = sub.add_parser("trabajo")
    j.add_argument("nombre", choices=sorted(TRABAJOS))
    j.add_argument("raiz")
    j.add_argument("entradas", nargs="+")
    j.add_argument("--ahora")
    j.add_argument("--lote")
    j.add_argument("--formato", choices=["parquet", "json"], default="parquet")
    i = sub.add_parser("inicializar")
    i.add_argument("raiz")
    i.add_argument("sf_dir")
    a = ap.parse_args(argv)

    if a.orden == "consultas":
        for k in sorted(plans.REGISTRO):
            print(k)
        return 0
    spark = SparkSession.builder.appName("matricula").getOrCreate()
    aplicar_ajustes(spark)
    if a.orden == "consulta":
        df = plans.REGISTRO[a.clave](spark, a.sf_dir)
        if a.salida:
            df.write.mode("overwrite").parquet(a.salida)
        else:
            df.show(a.mostrar, truncate=False)
    elif a.orden == "inicializar":
        t = preparacion.cargar(spark, a.sf_dir)
        deposito.crear(spark, a.raiz, {n: t[n] for n in TABLAS})
    else:
        cambios = ENTRADAS[a.nombre]
        if len(a.entradas) > len(cambios):
            ap.error(f"{a.nombre} takes {', '.join(cambios)}")
        leidas = {c: _leer(spark, r, a.formato, c) for c, r in zip(cambios, a.entradas)}
        extra = {"ahora": a.ahora} if a.nombre in CON_HORA else {}
        if "veredictos" in leidas:
            extra["veredictos"] = leidas.pop("veredictos")
        print(TRABAJOS[a.nombre](spark, a.raiz, *leidas.values(), lote=a.lote, **extra))
    return 0


if __name__ == "__main__":
    sys.exit(main())
