"""plans of recollect."""
