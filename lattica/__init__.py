"""A relational query engine on Spark: typed relation graphs in, nested results out."""
