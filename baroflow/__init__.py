"""Weather-event analytics as Spark DataFrame transformations."""
