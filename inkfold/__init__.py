"""Spark jobs that turn tables and streams of quotation documents into contract texts."""
