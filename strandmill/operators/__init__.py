"""DataFrame to DataFrame operators on reads."""
