"""Relations, loaders, sinks and generators."""
