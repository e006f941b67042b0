"""quern: a Spark-native engine for building, cleaning and querying property graphs derived from text."""
