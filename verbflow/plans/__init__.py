"""From expressions to Spark columns and plans."""
