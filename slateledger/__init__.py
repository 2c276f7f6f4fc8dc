"""Statement analytics on Spark: text lines to typed invoice records, reports and evaluation."""
