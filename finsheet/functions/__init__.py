"""Part of finsheet."""
