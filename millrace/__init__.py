"""millrace: a PySpark-native analytics engine for corpora and recorded outcomes."""
