"""trajecta: ordered-trajectory analytics expressed as lazy Spark plans."""
