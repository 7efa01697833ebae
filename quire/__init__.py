"""Document-graph retrieval and corpus jobs as Spark DataFrame programs."""
