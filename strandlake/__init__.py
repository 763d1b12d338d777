"""strandlake: sequence similarity analytics expressed as Spark DataFrame plans."""
