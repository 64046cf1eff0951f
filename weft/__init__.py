"""weft: a Spark-native engine for segmenting, matching, validating and versioning documents."""
