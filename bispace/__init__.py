"""bispace: Spark-native analytics over entities that are described in two spaces."""
