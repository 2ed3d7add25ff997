"""beliefmill: corpora of discrete Bayesian networks as Spark DataFrames."""
