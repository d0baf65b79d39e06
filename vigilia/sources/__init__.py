from vigilia.sources.schemas import CARE, CLINIC
from vigilia.sources.tables import load_tables, read_feed, write_table

__all__ = ["CARE", "CLINIC", "load_tables", "read_feed", "write_table"]
