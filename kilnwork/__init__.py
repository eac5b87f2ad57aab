"""Part of the kilnwork engine."""
