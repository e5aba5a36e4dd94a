"""The operators, each a function from relations to a relation."""
