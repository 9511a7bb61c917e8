"""Column builders: native expressions that compose."""
