"""The named jobs: staging, models, serving queries, enrichment and quality checks."""
