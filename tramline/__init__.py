"""Transit performance analytics as Spark DataFrame programs."""
