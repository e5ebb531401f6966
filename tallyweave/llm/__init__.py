"""Training-data operators: ten corpus operations and the pipeline's stages."""
