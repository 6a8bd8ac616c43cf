"""streaming of recollect."""
