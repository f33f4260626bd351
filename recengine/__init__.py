"""recengine: Spark-native operators for building and evaluating item recommenders."""
