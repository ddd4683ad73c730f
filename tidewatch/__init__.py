"""Tidewatch: continuous assurance of a deployed risk model, and corpus preparation, on PySpark."""
