"""Part of the tidemark package."""
