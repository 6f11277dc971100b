"""sparkloom: a Spark-native engine for evidence analytics over web and document corpora."""
