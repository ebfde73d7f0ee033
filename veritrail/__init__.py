"""Evidence analytics on PySpark: pairing, scoring, recall, snapshot diffs, audit and security roll-ups."""
