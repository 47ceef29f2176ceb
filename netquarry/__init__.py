"""Layout-capacitance analytics on Spark."""
