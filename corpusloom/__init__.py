"""corpusloom: a Spark-native engine for addressed text corpora and the annotations aligned to them."""
