"""rolecall: a Spark-first posting intelligence and corpus preparation engine."""
