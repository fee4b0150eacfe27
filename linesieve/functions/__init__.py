"""Part of linesieve."""
