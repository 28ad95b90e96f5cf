"""Document validation, OCR reconciliation and corpus preparation on Spark."""
