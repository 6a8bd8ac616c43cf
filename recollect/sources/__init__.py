"""sources of recollect."""
