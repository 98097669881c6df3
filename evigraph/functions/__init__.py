"""Column functions: text, routes, classification and scores."""
