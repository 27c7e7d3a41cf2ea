"""buildlens: build-failure log analytics as Spark jobs."""
