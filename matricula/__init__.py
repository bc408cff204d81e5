"""matricula: Spark-native enrolment and payment-reconciliation engine.

Entry points:

* ``matricula.operators.consultas``: reads (offers with seats left, the reconciliation grid,
  lots awaiting review, dashboard totals, batched lookups);
* ``matricula.operators.admision`` / ``lotes`` / ``cambios`` / ``otp``: change jobs over a table
  map and a DataFrame of requests, returning new table snapshots;
* ``matricula.plans.trabajos``: the same jobs against tables at rest, with their results, outbox
  and audit rows (``matricula.sources.deposito``);
* ``matricula.streaming.registro_continuo``: registration admission as a stream;
* ``matricula.plans``: the query catalogue (``REGISTRO``) with DuckDB oracle SQL (``ORACULO``).
"""
