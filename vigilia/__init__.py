"""Care-facility analytics expressed as Spark DataFrame plans.

The package is organised by what a caller needs:

``sources``    table schemas, readers, writers and sensor feeds
``functions``  column expressions (clock, rounding, labels, bands)
``operators``  reusable set-level operators (latest row, as-of, overlap, ...)
``plans``      the named reports, views, lists, alerts and table changes
``streaming``  the same alert rules as Structured Streaming jobs
"""
