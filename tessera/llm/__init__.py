"""Training-data operators: each module holds one operator, `queries` the contract queries over the tables."""
