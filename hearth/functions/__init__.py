"""Column functions: text to facts, text cleaning, normalising, parsing and display."""
