"""tidemark: Spark-native analytics over releases, the entities they mention, and their catalogue."""
