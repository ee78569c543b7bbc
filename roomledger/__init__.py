"""Booking and revenue analytics as Spark DataFrame operators.

Packages: ``sources`` (readers, writers, adapters), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame), ``plans`` (named
queries composed from operators, with their SQL counterparts).
"""
