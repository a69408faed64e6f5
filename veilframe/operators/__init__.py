"""Detection, resolution, numbering, rewriting and restoring as DataFrame operators."""
