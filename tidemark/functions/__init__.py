"""Column expressions, all evaluated inside the JVM."""
