"""cartmill: price comparison, listing resolution and basket planning on Spark."""
