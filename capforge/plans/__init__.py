"""Query plans over the driver tables: fixture views, feature-pipeline steps, checks."""
