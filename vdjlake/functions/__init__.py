"""Column functions: cleaning of values, sequences, genes and names."""
