"""Part of vertexloom."""
