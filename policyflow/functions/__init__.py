"""Column in, column out. Everything here stays in the JVM."""
