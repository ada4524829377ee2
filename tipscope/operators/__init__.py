"""Table-level operators: windows, joins and aggregations."""
