"""citegrain: Spark-native document retrieval, grounding and corpus analytics."""
