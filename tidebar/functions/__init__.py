"""Column expressions and ordered folds."""
