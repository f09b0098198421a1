"""millrace: batch analytics over feed-ingested, semi-structured postings, as Spark plans."""
