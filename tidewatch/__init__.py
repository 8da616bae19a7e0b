"""Payment-transaction analytics on Spark: canonical mapping, features, rules, scoring, evaluation."""
