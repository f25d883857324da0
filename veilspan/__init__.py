"""Find, redact and audit personal data in large document collections on Spark."""
