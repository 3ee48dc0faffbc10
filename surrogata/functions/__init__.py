"""Column-expression functions (JVM-side) and small numpy helpers."""
