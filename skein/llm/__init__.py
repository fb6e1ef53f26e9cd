"""Operators on document text: encoding, mixing and look-alike text."""
