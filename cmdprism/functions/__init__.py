"""Pure ``Column`` functions, shared by the batch and the streaming operators."""
