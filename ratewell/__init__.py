"""ratewell: Spark-native evaluation of language-model answers against human and automatic raters."""
