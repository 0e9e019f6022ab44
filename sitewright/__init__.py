"""Spark-native genomic site discovery: scans, guide libraries, joins, annotation, scoring and interval work as DataFrame plans."""
