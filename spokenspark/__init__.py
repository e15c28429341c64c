"""Written text to spoken text at table scale, with Spark's own plans."""
