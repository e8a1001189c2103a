"""One module per registered query: the contract columns, taken from the operator."""
