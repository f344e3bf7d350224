"""Folder of the smallest driver tables."""

SF_SMALL = "/root/testdata/sf0.001"
