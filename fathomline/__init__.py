"""fathomline: a Spark-native research-evidence engine."""
