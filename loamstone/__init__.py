"""loamstone: a PySpark-native engine for analysing and searching text and source-code corpora."""
