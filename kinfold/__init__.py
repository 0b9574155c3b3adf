"""Re-identification by embedding similarity, as Spark plans."""
