"""Column functions: text normalization, array sets, fuzzy scorers."""
