"""Inputs: driver tables, request intake, JSON decoding, scenario data."""
