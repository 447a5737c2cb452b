"""Feature selection and model evaluation for labelled tables, written as Spark DataFrame jobs."""
