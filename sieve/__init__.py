"""sieve: choosing which rows of a labelled text corpus are worth training on, as Spark DataFrame operations."""
