"""Document preparation and analytics on Spark."""
