"""Where relations come from and where they go."""

from .readers import from_rows, read_blocks, read_csv, read_lines, reuse, whole_text_files
from .sinks import save_text, single_text_file, store_rows, write_formatted

__all__ = ["from_rows", "read_blocks", "read_csv", "read_lines", "reuse", "save_text", "single_text_file", "store_rows", "whole_text_files", "write_formatted"]
