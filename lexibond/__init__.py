"""Word-pair association analytics on Spark: n-gram sources, counts, log-likelihood scores, top pairs."""
