"""Column functions: JVM-side expressions without Python workers."""
