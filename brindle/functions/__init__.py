"""Column functions: text, URLs, HTML, prices, robots rules."""
