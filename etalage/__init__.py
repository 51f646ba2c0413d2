"""Retail price comparison as Spark jobs: listings in, comparable prices and indicators out."""
