"""Dossier: analytics over archives of reviewed documents, as Spark DataFrame functions."""
