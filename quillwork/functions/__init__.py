"""Part of quillwork; see README."""
