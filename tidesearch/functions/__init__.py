"""Column functions: text, numbers, dates and the pluggable embedding."""
