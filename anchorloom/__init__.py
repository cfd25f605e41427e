"""anchorloom: a Spark-first engine for genomic-interval features and pairwise classification."""
