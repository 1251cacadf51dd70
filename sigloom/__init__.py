"""Cross-sectional factor research as ordinary Spark DataFrame jobs."""
