"""Column-parameterised DataFrame operators (see SURVEY section 2 for the IDs)."""
