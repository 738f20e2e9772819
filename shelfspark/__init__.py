"""Product-catalog and image-quality analytics on Spark."""
