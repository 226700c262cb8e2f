"""Decoding and encoding of typed documents as Catalyst expressions."""
