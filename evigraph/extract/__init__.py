"""Facts from source files: nodes and edges with the lines that show them."""
