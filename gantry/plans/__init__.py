"""The assembled pipeline and its registered queries."""
