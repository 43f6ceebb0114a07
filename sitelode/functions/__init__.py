"""Column-in, Column-out building blocks. All of them stay inside the JVM by default."""
