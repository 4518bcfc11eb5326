"""quernflow: a Spark-native medallion analytics engine."""
