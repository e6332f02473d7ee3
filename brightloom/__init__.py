"""brightloom: corpus analytics as composable Spark DataFrame transformations."""
