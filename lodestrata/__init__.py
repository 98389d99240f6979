"""lodestrata: a Spark-native engine for document and spreadsheet corpora."""
