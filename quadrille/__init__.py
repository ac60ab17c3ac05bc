"""Rule, graph-pattern and corpus analytics expressed as Spark DataFrame plans."""
