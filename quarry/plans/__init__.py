"""The SQL dialect: text to tokens to a tree to a DataFrame."""
