"""corpusloom: PySpark-native document-corpus processing and analytics."""
