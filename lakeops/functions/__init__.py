"""Column expressions; everything here stays in the JVM except ``objects.inflate``."""
