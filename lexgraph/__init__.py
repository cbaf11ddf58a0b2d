"""lexgraph: a Spark-first analytics engine for provenance-carrying knowledge graphs."""
