"""mdloom: Markdown analytics and training-data preparation on Spark."""
