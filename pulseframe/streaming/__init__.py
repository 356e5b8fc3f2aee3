from pulseframe.streaming.incremental import import_new_files

__all__ = ["import_new_files"]
