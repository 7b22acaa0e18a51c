"""quern: knowledge-graph and text analytics as plain Spark DataFrame operators."""
