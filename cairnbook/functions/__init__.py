"""Column functions: they take and return Columns and stay inside code generation."""
