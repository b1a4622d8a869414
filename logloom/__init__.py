"""Source-linked log analytics as Spark plans."""
