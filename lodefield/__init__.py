"""Spatial estimation of drill-hole grades as Spark DataFrame operators."""
