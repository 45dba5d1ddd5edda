"""Operators on trees, voxels, regions, clusters, recipes, samples, graphs and maps."""
