"""Session settings: cluster sizing applies only where the session sets nothing."""

from matricula.sesion import AJUSTES_CLUSTER, ajustes_cluster


def test_ajustes_cluster_respeta_lo_explicito(spark):
    clave = "spark.sql.files.maxPartitionBytes"
    otra = "spark.sql.adaptive.skewJoin.skewedPartitionFactor"
    previo_otra = spark.conf.get(otra)
    particiones = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(clave, "1234")
    try:
        ajustes_cluster(spark)
        assert spark.conf.get(clave) == "1234"
        assert spark.conf.get("spark.sql.shuffle.partitions") == particiones  # set by the test session
        assert spark.conf.get(otra) == AJUSTES_CLUSTER[otra]
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    finally:
        spark.conf.unset(clave)
        spark.conf.set(otra, previo_otra)
