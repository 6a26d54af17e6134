"""sightline: photogrammetric survey data as Spark DataFrame jobs."""
