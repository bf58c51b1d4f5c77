"""Part of loregrid."""
