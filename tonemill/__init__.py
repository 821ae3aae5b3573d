"""tonemill: labelled-text analytics expressed as Spark DataFrame jobs."""
