"""Empty on purpose: selection is a batch job, no operator of this library works on streams."""
