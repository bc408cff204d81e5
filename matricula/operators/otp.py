"""One-time access codes, re-aimed as batch jobs over requests
and attempts.

Validation of an attempt (email, code, time): both fields are required (``faltan_datos``); the newest token (highest id) with that e-mail
and code is the one checked; no token -> ``incorrecto``; token already used -> ``usado``;
attempt time after expiry -> ``expirado`` (at expiry is still valid); else ``ok`` and the token
becomes used. Attempts are taken in time order, so after the first ``ok`` on a token every later
attempt on it finds it used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import escalares as E
from . import consultas as C
from .secuencia import mayor_valor, numerar


def token_vigente(tokens: DataFrame) -> DataFrame:
    """Newest token per (email, code): an aggregate with map-side partial results (top-1 per key
    without a window)."""
    return tokens.groupBy("email", "codigo").agg(
        F.max(F.struct("id_otp", "expira_en", "usado")).alias("tk")
    ).select("email", "codigo", F.col("tk.id_otp").alias("id_otp"), F.col("tk.expira_en").alias("expira_en"),
             F.col("tk.usado").alias("usado"))


def otp_intentos(t, intentos: DataFrame) -> DataFrame:
    """Verdict of each attempt (``intento_id, email, codigo, en``)."""
    faltan = E.vacio("email") | E.vacio("codigo")
    incompletos = intentos.where(faltan).select(
        "intento_id", "email", "codigo", F.lit(None).cast("long").alias("id_otp"), F.lit("faltan_datos").alias("veredicto")
    )
    intentos = intentos.where(~faltan)
    claves = intentos.select("email", "codigo").distinct()
    tk = token_vigente(t["token_otp"].join(claves, ["email", "codigo"], "left_semi"))
    a = intentos.select("intento_id", "email", "codigo", "en").join(tk, ["email", "codigo"], "left")
    # First attempt on each token (aggregate, not a window); later attempts see the token used
    # if that first attempt was in time.
    primero = a.where(F.col("id_otp").isNotNull()).groupBy("id_otp").agg(
        F.min(F.struct("en", "intento_id")).alias("pri")
    )
    a = a.join(primero, "id_otp", "left")
    es_primero = (F.col("pri.en") == F.col("en")) & (F.col("pri.intento_id") == F.col("intento_id"))
    a_tiempo = lambda c: c <= F.col("expira_en")
    veredicto = (
        F.when(F.col("id_otp").isNull(), F.lit("incorrecto"))
        .when(E.es_uno("usado"), F.lit("usado"))
        .when(~es_primero & F.coalesce(a_tiempo(F.col("pri.en")), F.lit(False)), F.lit("usado"))
        .when(~F.coalesce(a_tiempo(F.col("en")), F.lit(False)), F.lit("expirado"))
        .otherwise(F.lit("ok"))
    )
    return a.select("intento_id", "email", "codigo", "id_otp", veredicto.alias("veredicto")).unionByName(incompletos)


def con_usados(tokens: DataFrame, usados: DataFrame) -> DataFrame:
    """Tokens with those of ``usados(id_otp)`` marked used; other columns stay."""
    marca = usados.select("id_otp").distinct().withColumn("__u", F.lit(True))
    return tokens.join(marca, "id_otp", "left").withColumn(
        "usado", F.when(F.col("__u"), F.lit(1)).otherwise(F.col("usado"))
    ).select(*tokens.columns)


def tokens_tras_intentos(t, veredictos: DataFrame) -> DataFrame:
    """Tokens with an accepted attempt are marked used."""
    return con_usados(t["token_otp"], veredictos.where(F.col("veredicto") == "ok"))


def tokens_nuevos(t, solicitudes: DataFrame, minutos: int = E.MINUTOS_OTP) -> DataFrame:
    """The tokens that a batch of requests leaves, see ``emitir_tokens``."""
    tk = t["token_otp"]
    num = numerar(solicitudes.select("solicitud_id", "email", "codigo", "en"), ["en", "solicitud_id"], "rn")
    ultima = num.groupBy("email").agg(F.max(F.struct("en", "solicitud_id", "rn", "codigo")).alias("ult"))
    tipo_exp = tk.schema["expira_en"].dataType
    base = mayor_valor(tk, "id_otp")
    return ultima.select(
        (F.col("ult.rn") + F.lit(base)).alias("id_otp"), "email", F.col("ult.codigo").alias("codigo"),
        E.expira(F.col("ult.en"), minutos).cast(tipo_exp).alias("expira_en"), F.lit(0).alias("usado"),
    )


def emitir_tokens(t, solicitudes: DataFrame, minutos: int = E.MINUTOS_OTP) -> DataFrame:
    """Each request (``solicitud_id, email, codigo, en``) deletes every token of its e-mail
    and adds one expiring ``minutos`` later. Ids are assigned to every request in arrival order
    (auto increment), so the surviving token of an e-mail is its last request with that id."""
    quedan = t["token_otp"].join(solicitudes.select("email").distinct(), "email", "left_anti")
    return quedan.unionByName(tokens_nuevos(t, solicitudes, minutos))


def solicitudes_emitidas(t, personas: DataFrame, empresas: DataFrame) -> DataFrame:
    """Requests that get a code: people's requests with both fields, and company-portal
    requests whose (document, e-mail) is a registered contact (P3); ``de_empresa`` tells them apart."""
    p = personas.where(~(E.vacio("cedula") | E.vacio("email"))).select(
        "solicitud_id", "email", "codigo", "en", F.lit(False).alias("de_empresa")
    )
    autorizadas = C.contactos_autorizados(t, empresas.where(~(E.vacio("cedula") | E.vacio("email")))).select("solicitud_id")
    e = empresas.join(autorizadas, "solicitud_id", "left_semi").select(
        "solicitud_id", "email", "codigo", "en", F.lit(True).alias("de_empresa")
    )
    return p.unionByName(e)


#: Life of a company session after an accepted code (fixed value).
HORAS_SESION = 2


def sesiones(veredictos: DataFrame, horas: int = HORAS_SESION) -> DataFrame:
    """Accepted codes (``email, en, veredicto``) per e-mail and slot of one session life: first and last time in the slot."""
    slot = F.floor(F.unix_micros(F.col("en").cast("timestamp")) / F.lit(horas * 3_600_000_000))
    return veredictos.where((F.col("veredicto") == "ok") & F.col("en").isNotNull()).groupBy(
        F.col("email").alias("sesion_email"), slot.alias("slot")
    ).agg(F.min(F.col("en").cast("timestamp")).alias("primera"), F.max(F.col("en").cast("timestamp")).alias("ultima"))


def autorizar(t, envios: DataFrame, veredictos: DataFrame, horas: int = HORAS_SESION) -> DataFrame:
    """P19 and P3 with session life: ``envios`` (``empresa_id``, ``sesion_email``, ``en``, ...) with ``motivo``, null if the
    company may act. A session is the newest accepted code of its e-mail (``veredictos``: ``email, en, veredicto``), alive
    from then on for less than ``horas`` hours. In the server's order: no time of arrival (``sin_fecha``), no code accepted before
    (``sin_codigo``), too old (``sesion_expirada``), the session of another e-mail than the company's (``codigo_ajeno``), no such
    contact (``sin_contacto``). A null ``sesion_email`` stands for the company's own.

    The as-of join needs no window: a code within the life lies in the request's own slot, no later than it, or in the one
    before, late enough, so the first and last time per e-mail and slot decide it by two equi-joins."""
    ce = t["contacto_empresa"].select(F.col("id_contacto").alias("empresa_id"), F.col("emp_email").alias("email_empresa"))
    e = envios.join(ce, "empresa_id", "left").withColumn("sesion_email", F.coalesce("sesion_email", "email_empresa"))
    en = F.col("en").cast("timestamp")
    e = e.withColumn("slot", F.floor(F.unix_micros(en) / F.lit(horas * 3_600_000_000)))
    s = sesiones(veredictos, horas)
    propia = s.select("sesion_email", "slot", F.col("primera").alias("__propia"))
    previa = s.select("sesion_email", (F.col("slot") + 1).alias("slot"), F.col("ultima").alias("__previa"))
    alguna = s.groupBy("sesion_email").agg(F.min("primera").alias("__alguna"))
    e = e.join(propia, ["sesion_email", "slot"], "left").join(previa, ["sesion_email", "slot"], "left").join(alguna, "sesion_email", "left")
    viva = F.coalesce(F.col("__propia") <= en, F.lit(False)) | F.coalesce(en < F.col("__previa") + F.expr(f"INTERVAL {int(horas)} HOURS"), F.lit(False))
    motivo = (
        F.when(en.isNull(), "sin_fecha")
        .when(~F.coalesce(F.col("__alguna") <= en, F.lit(False)), F.when(F.col("email_empresa").isNull() & F.col("sesion_email").isNull(), "sin_contacto").otherwise("sin_codigo"))
        .when(~viva, "sesion_expirada")
        .when(F.col("email_empresa").isNull(), "sin_contacto")
        .when(F.col("sesion_email") != F.col("email_empresa"), "codigo_ajeno")
    )
    return e.select(*envios.columns, motivo.alias("motivo"))
