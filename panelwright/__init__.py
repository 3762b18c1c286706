"""Cross-sectional return analytics as lazy Spark plans."""
