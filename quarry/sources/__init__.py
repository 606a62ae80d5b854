from quarry.sources.tables import TABLES, load_table, register_tables  # noqa: F401
