"""Column functions and Arrow UDFs over identifiers, text and expressions."""
