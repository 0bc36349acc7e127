"""Retail analytics and question-feedback engine, written as Spark DataFrame jobs."""
