"""Analytics over knowledge graphs kept in four DataFrames: entities, facts, relations and diagnostics."""
