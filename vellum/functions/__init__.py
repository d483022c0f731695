"""Part of vellum; see the package README."""
