"""loomframe: data preparation, profiling and analysis as Spark DataFrame operators."""
