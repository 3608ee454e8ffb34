"""DataFrame to DataFrame operators, grouped by capability."""
