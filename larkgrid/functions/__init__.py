"""Part of the larkgrid engine."""
