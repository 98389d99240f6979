"""Column expressions for text, numbers, keys and periods. Everything here stays in the JVM."""
