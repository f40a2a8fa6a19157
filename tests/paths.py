"""Folders of the given tables that the tests read."""

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
