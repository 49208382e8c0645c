"""Column expressions used inside the table operators (all JVM-side unless noted)."""
