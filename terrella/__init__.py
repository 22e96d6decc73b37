"""terrella: deterministic grid-terrain analytics and corpus preparation as Spark plans."""
