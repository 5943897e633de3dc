"""Spark-native ledger reconciliation: declarative plans over money, calendar and text columns."""
