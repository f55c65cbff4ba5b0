"""tatterloom: a Spark-native engine for ragged delimited text."""
