"""rivalry — pairwise-preference data preparation and evaluation on Spark.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, so Catalyst keeps filters, projections and partial aggregation
in the JVM.  Sub-packages:

* ``functions``  column expressions (list parsing, templates, probabilities, vectors)
* ``operators``  DataFrame operators (labels, folds, joins, metrics, calibration, kNN, ML)
* ``sources``    readers / writers (CSV, JSONL, vectors, run metadata)
* ``streaming``  Structured Streaming ingestion and incremental counts
* ``plans``      derived fixtures and the registered queries
"""

__all__ = ["session"]
