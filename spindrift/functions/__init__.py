"""Column functions: everything here is an expression that Catalyst can see through."""
