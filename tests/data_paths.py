"""Folders of the driver's tables that the tests read."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
