"""Plan tables composed from the other operators."""
