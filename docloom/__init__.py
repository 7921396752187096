"""docloom: a Spark-native document retrieval and corpus engine."""
