"""Reading and writing: copies with counts, handlers by suffix, Arrow producers, filterable sources."""
