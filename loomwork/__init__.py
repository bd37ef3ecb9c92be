"""loomwork: a Spark-first engine for wide survey tables and training-data corpora."""
