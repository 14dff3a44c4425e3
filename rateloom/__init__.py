"""rateloom: adjusted-rate analytics over event tables, written as Spark DataFrame jobs."""
