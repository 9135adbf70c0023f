"""Spark-native document transcription: documents as DataFrames, braille pages as results."""
