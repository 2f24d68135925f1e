"""Column functions: pure expressions, evaluated inside the JVM."""
