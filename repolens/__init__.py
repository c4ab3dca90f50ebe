"""repolens: a Spark-native engine for questions about source code and text corpora."""
