"""Column expressions shared by the plans; all run inside the JVM."""
