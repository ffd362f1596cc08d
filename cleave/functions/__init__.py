"""Part of cleave."""
