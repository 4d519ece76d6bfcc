"""Record quality and entity standardisation as DataFrame, Column and streaming operators."""
