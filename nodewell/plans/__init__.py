"""Complete queries: which tables feed which jobs."""
