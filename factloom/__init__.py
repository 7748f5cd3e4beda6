"""A Spark-first engine for facts that are derived from versioned inputs and kept correct as the inputs change."""
