"""Ledgerline: a PySpark-native engine that keeps a master list of establishments."""
