"""taskweave: task descriptions into training and evaluation tables, as Spark DataFrame operators."""
