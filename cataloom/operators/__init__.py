"""DataFrame -> DataFrame operators. None of them collects rows or holds a group in one task."""
