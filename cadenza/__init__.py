"""Series and similarity analytics on Spark."""
