"""quern.plans."""
