"""Query catalogue and composite jobs."""
