"""Column functions: text, URL and region rules."""
