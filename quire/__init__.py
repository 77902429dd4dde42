"""A document-layout and text-analytics engine on Spark."""
