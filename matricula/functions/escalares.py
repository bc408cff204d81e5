"""Scalar rules as Column expressions; all JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and formats the application shows (they must stay as written).
ESTADOS = ("pendiente", "en_revision", "conciliado", "rechazado")
ETIQUETA_ESTADO = {"pendiente": "Pendiente", "en_revision": "En Revisión", "conciliado": "Conciliado"}
ETIQUETA_ESTADO_OTRO = "Rechazado"
SIN_EMPRESA = "SIN_EMPRESA"
FORMATO_FECHA = "dd/MM/yyyy"  # DATE_FORMAT(d, '%d/%m/%Y')
FORMATO_FECHA_HORA = "dd/MM/yyyy hh:mm a"  # DATE_FORMAT(ts, '%d/%m/%Y %h:%i %p')
FORMATO_ISO = "yyyy-MM-dd"
FORMATO_LOCAL = "d/M/yyyy"  # toLocaleDateString() in es-VE
CODPAIS_DEFECTO = "+58"
MINUTOS_OTP = 15


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fecha_corta(c) -> Column:
    """day/month/year."""
    return F.date_format(_c(c), FORMATO_FECHA)


def fecha_hora(c) -> Column:
    """day/month/year 12-hour clock with AM/PM."""
    return F.date_format(_c(c), FORMATO_FECHA_HORA)


def primera_mayuscula(c) -> Column:
    """first character upper case, the rest lower case (not initcap: 'aNA maria' -> 'Ana maria')."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def telefono_completo(codpais, telefono) -> Column:
    """country code and number joined by one space."""
    return F.concat(_c(codpais), F.lit(" "), _c(telefono))


def codpais_de(telefono) -> Column:
    """country code = text before the first space; +58 when there is no space or no phone."""
    t = F.coalesce(_c(telefono), F.lit(""))
    return F.when(F.instr(t, " ") > 0, F.substring_index(t, " ", 1)).otherwise(F.lit(CODPAIS_DEFECTO))


def numero_de(telefono) -> Column:
    """number = everything after the first space; the whole text when there is no space."""
    t = F.coalesce(_c(telefono), F.lit(""))
    posicion = F.instr(t, " ")
    return F.when(posicion > 0, F.substring(t, posicion + 1, 1 << 30)).otherwise(t)


def sin_ceros_iniciales(c) -> Column:
    """strip leading zeros."""
    return F.regexp_replace(_c(c), r"^0+", "")


#: White space and line ends that a page's ``trim`` takes off (fixed value).
BLANCOS = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def recortar(c) -> Column:
    """trim, as the page does."""
    return F.btrim(_c(c), F.lit(BLANCOS))


def no_negativo(c) -> Column:
    """F8: clamp at zero."""
    return F.greatest(F.lit(0), _c(c))


def es_uno(c) -> Column:
    """``x === 1``: null counts as false."""
    return F.coalesce(_c(c) == 1, F.lit(False))


def etiqueta_cupos(bloqueado, restantes) -> Column:
    """CERRADO when blocked, else AGOTADO when none left, else null."""
    return F.when(es_uno(bloqueado), F.lit("CERRADO")).when(_c(restantes) <= 0, F.lit("AGOTADO"))


def oferta_deshabilitada(bloqueado, restantes) -> Column:
    """an offer card is disabled when blocked or when none are left."""
    return es_uno(bloqueado) | F.coalesce(_c(restantes) <= 0, F.lit(False))


def etiqueta_estado(c) -> Column:
    """enrolment state label; anything unknown shows as Rechazado."""
    c = _c(c)
    e = F.lit(ETIQUETA_ESTADO_OTRO)
    for k, v in reversed(list(ETIQUETA_ESTADO.items())):
        e = F.when(c == k, F.lit(v)).otherwise(e)
    return e


def etiqueta_oferta(estatus) -> Column:
    """ACTIVA when the flag is 1, else INACTIVA."""
    return F.when(es_uno(estatus), F.lit("ACTIVA")).otherwise(F.lit("INACTIVA"))


def empresa_o_defecto(c) -> Column:
    """company name, SIN_EMPRESA when null or empty."""
    c = _c(c)
    return F.when(c.isNull() | (c == ""), F.lit(SIN_EMPRESA)).otherwise(c)


def fecha_iso(c) -> Column:
    """ISO date text."""
    return F.date_format(_c(c), FORMATO_ISO)


def fecha_local(c) -> Column:
    """locale date text (day/month/year without padding)."""
    return F.date_format(_c(c), FORMATO_LOCAL)


def nombre_completo(nombre, apellido) -> Column:
    """``nombre apellido``."""
    return F.concat(_c(nombre), F.lit(" "), _c(apellido))


def codigo_documento(tipodoc, doc) -> Column:
    """``tipodoc-doc``."""
    return F.concat(_c(tipodoc), F.lit("-"), _c(doc))


def etiqueta_con_id(nombre, palabra: str, codigo) -> Column:
    """``nombre (palabra codigo)``, the text of an option in a page's list; a null name shows as ``null``."""
    return F.concat(F.coalesce(_c(nombre), F.lit("null")), F.lit(f" ({palabra}"), _c(codigo).cast("string"), F.lit(")"))


def entero_js(c) -> Column:
    """F16: parseInt semantics: leading integer of the text ('5abc' -> 5), null when there is none."""
    m = F.regexp_extract(F.coalesce(_c(c).cast("string"), F.lit("")), r"^\s*([+-]?\d+)", 1)
    return F.when(m == "", F.lit(None).cast("bigint")).otherwise(m.try_cast("bigint"))


def vacio(c) -> Column:
    """D16 required-field rule: null or the empty string (whitespace counts as present)."""
    c = _c(c)
    return c.isNull() | (c.cast("string") == "")


def expira(ts, minutos: int = MINUTOS_OTP) -> Column:
    """time plus the one-time-code life."""
    return _c(ts) + F.expr(f"INTERVAL {int(minutos)} MINUTES")
