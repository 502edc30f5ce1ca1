"""wardline: text moderation and label curation as Spark DataFrame operators."""
