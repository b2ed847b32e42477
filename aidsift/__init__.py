"""aidsift: Spark DataFrame operators for classifying and linking text-bearing
financial records (keyword/code rules, null-safe merges, record linkage,
seeded sampling, batch scoring, evaluation metrics and enrichment).

Every operator is a pure ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function built from Spark SQL expressions, so Catalyst sees one lazy plan.
"""

__version__ = "0.1.0"
