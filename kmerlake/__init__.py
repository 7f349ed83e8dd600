"""kmerlake: a Spark-native engine that classifies sequences by shared k-mers."""
