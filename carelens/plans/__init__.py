"""Plans: the daily pipeline and the registry of checked queries."""
