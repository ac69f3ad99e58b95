"""Query registry: every query with its oracle SQL."""
