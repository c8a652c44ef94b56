"""Code and document intelligence as composable Spark DataFrame operators."""
