"""quern.functions."""
