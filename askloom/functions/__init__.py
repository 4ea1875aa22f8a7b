"""Column functions: text, maths, rules and scorer hooks."""
