"""tallyforge: compositional survey and vote analytics as Spark DataFrame jobs."""
