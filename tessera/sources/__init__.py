"""Sources: adapters of evaluation data sets to documents and queries."""
