"""quern.sources."""
