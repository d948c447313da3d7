"""Single operators of the expression library as named examples on a panel."""
