"""Vector arithmetic as column expressions (``vectors``) and as Arrow/numpy kernels (``dense``)."""
