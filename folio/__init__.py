"""folio: a Spark-native engine for preparing document corpora."""
