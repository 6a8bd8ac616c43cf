"""functions of recollect."""
