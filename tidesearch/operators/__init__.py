"""DataFrame operators: filters, joins, aggregates, rankings, tagging, vectors and fusion."""
