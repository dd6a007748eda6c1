"""Column -> Column building blocks; no function here touches rows in Python."""
