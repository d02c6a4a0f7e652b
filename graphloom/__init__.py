"""Knowledge-graph, retrieval and telemetry jobs as Spark DataFrames."""
