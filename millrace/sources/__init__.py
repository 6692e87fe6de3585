from millrace.sources.tables import arriving, scratch_path, stream_table, table

__all__ = ["scratch_path", "stream_table", "table"]
