"""DataFrame -> DataFrame operators, grouped by the analysis stage they serve."""
