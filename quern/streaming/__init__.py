"""quern.streaming."""
