"""Pallium: detect, mask, restore and audit personal data in text tables with Spark."""
