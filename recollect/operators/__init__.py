"""operators of recollect."""
