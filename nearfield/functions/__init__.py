"""Part of nearfield."""
