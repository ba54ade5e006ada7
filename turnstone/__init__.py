"""Spark-first analytics for spoken-call transcripts: segmentation, hedging, claim checks, revision."""
