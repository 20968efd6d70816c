"""tariffgrid: price-catalog analytics as Spark DataFrame jobs."""

SCHEMA_VERSION = "3.1"
