"""Data operators: plain DataFrame transformations."""
