"""Readers and writers: morphology text, nested documents, keyed tables, voxel volumes."""
