"""Sources that Spark lacks."""
