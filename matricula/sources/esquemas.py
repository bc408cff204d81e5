"""Explicit schemas (never inferred) of the domain tables and change sets."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DateType(), T.TimestampType()


def _st(*campos) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in campos])


TABLAS: dict[str, T.StructType] = {
    "persona": _st(("pertipodoc", S), ("perdoc", S), ("pernombre", S), ("perapellido", S), ("perfechanac", D),
                   ("pertelefono", S), ("peremail", S), ("perpais", S), ("perciudad", S)),
    "capacitacion": _st(("capcodigo", I), ("capnombre", S)),
    "capacitacion_oferta": _st(("capofcodigo", L), ("capofcapcodigo", I), ("capoffecha_inicio", D),
                               ("capoffecha_fin", D), ("capofcupos", I), ("capofestatus", I), ("cupos_bloqueados", I)),
    "contacto_empresa": _st(("id_contacto", L), ("empresa_nombre", S), ("emp_tipodoc", S), ("emp_doc", S),
                            ("emp_nombre", S), ("emp_apellido", S), ("emp_email", S), ("emp_telefono", S),
                            ("creado_en", TS)),
    "inscripcion": _st(("inscodigo", L), ("ins_perdoc", S), ("ins_oferta", L), ("ins_empresa_id", L),
                       ("ins_estado", S), ("ins_fecha", TS)),
    "persona_capacitacion": _st(("pcap_perdoc", S), ("pcap_oferta", L)),
    "pago_reportado": _st(("pago_inscodigo", L), ("pago_empresa_id", L), ("titular_nombre", S),
                          ("titular_apellido", S), ("titular_telefono", S), ("banco_origen", S), ("referencia", S),
                          ("fecha_reporte", TS)),
    "token_otp": _st(("id_otp", L), ("email", S), ("codigo", S), ("expira_en", TS), ("usado", I)),
}

EMPLEADO = _st(("tipodoc", S), ("doc", S), ("nombre", S), ("apellido", S), ("telefono", S), ("email", S),
               ("fechanac", S), ("pais", S), ("ciudad", S))

CAMBIOS: dict[str, T.StructType] = {
    "solicitud_registro": _st(("solicitud_id", L), ("tipodoc", S), ("doc", S), ("nombre", S), ("apellido", S),
                              ("codpais", S), ("telefono", S), ("email", S), ("pais", S), ("ciudad", S),
                              ("fechanac", S), ("capacitacion", L), ("recibido_en", TS)),
    # Nested lot record as the company portal posts it: one row per lot, employees in order.
    "lote": T.StructType([
        T.StructField("lote_id", L), T.StructField("empresa_id", L), T.StructField("oferta", L),
        T.StructField("empleados", T.ArrayType(T.StructType([T.StructField("fila", L)] + EMPLEADO.fields))),
        T.StructField("sesion_email", S), T.StructField("en", TS),
    ]),
    "intento_otp": _st(("intento_id", L), ("email", S), ("codigo", S), ("en", TS)),
    "oferta_borrador": _st(("capofcapcodigo", I), ("fecha_inicio", D), ("fecha_fin", D), ("cupos", I)),
    "pago_solicitud": _st(("solicitud_id", L), ("inscodigo", L), ("titular_nombre", S), ("titular_apellido", S),
                          ("titular_telefono", S), ("banco_origen", S), ("referencia", S), ("tiene_comprobante", I)),
    "pago_lote_solicitud": _st(("solicitud_id", L), ("empresa_id", L), ("oferta", L), ("titular_nombre", S), ("titular_apellido", S),
                               ("titular_telefono", S), ("banco_origen", S), ("referencia", S), ("tiene_comprobante", I), ("sesion_email", S), ("en", TS)),
    "decision_pago": _st(("inscodigo", L), ("decision", S), ("en", TS), ("solicitud_id", L)),
    "decision_lote": _st(("empresa_id", L), ("oferta", L), ("decision", S), ("en", TS), ("solicitud_id", L)),
    "eliminacion": _st(("inscodigo", L)),
    "oferta_edicion": _st(("solicitud_id", L), ("capofcodigo", L), ("capofcapcodigo", I), ("fecha_inicio", D), ("fecha_fin", D),
                          ("cupos", I), ("en", TS)),
    "toggle_oferta": _st(("solicitud_id", L), ("capofcodigo", L), ("campo", S), ("en", TS)),
    "persona_edicion": _st(("solicitud_id", L), ("doc", S), ("nombre", S), ("apellido", S), ("telefono", S), ("en", TS)),
    "contacto_alta": _st(("solicitud_id", L), ("empresa_nombre", S), ("emp_tipodoc", S), ("emp_doc", S), ("emp_nombre", S),
                         ("emp_apellido", S), ("emp_email", S), ("emp_telefono", S), ("en", TS)),
    "solicitud_otp": _st(("solicitud_id", L), ("cedula", S), ("email", S), ("codigo", S), ("en", TS)),
    "solicitud_otp_empresa": _st(("solicitud_id", L), ("cedula", S), ("email", S), ("codigo", S), ("en", TS)),
}

TODOS = {**TABLAS, **CAMBIOS}
