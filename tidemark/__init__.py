"""Text classification and transfer evaluation on labelled document tables, on Spark."""
