"""Patch containers and wire formats, and the tables read from them."""
