"""netlens: interaction networks and corpus preparation as Spark jobs."""
