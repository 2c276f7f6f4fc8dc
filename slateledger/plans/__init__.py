"""Query plans over the reference data model."""
