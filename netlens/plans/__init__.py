"""Loop control for fixpoints that a single plan cannot express."""
