"""Part of kgspark; see the package README."""
